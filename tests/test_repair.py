"""Repair of text on cases written here."""

from pyspark.sql import functions as F

from epistle.functions.repair import decoded, rtf_text, stemmed


def test_decoded(spark):
    rows = [
        (1, b"plain\r\nx\0", None), (2, "é".encode("cp1252"), "latin-1"), (3, "żółć".encode(), None), (4, "é".encode("cp1252"), None), (5, ("é" * 70).encode("cp1252"), None),
        (6, "don’t café".encode().decode("cp1252").encode(), None), (7, None, None), (8, b"", None), (9, "é".encode("cp1252"), "no-such-charset"), (10, "ÂA é".encode(), None),
    ]
    df = spark.createDataFrame(rows, "i int, raw binary, declared string").select("i", decoded("raw", "declared").alias("d")).select("i", "d.*")
    got = {r["i"]: (r["text"], r["confidence"]) for r in df.collect()}
    assert got == {
        1: ("plain\nx", 1.0), 2: ("é", 1.0), 3: ("żółć", 0.9), 4: ("é", 0.7), 5: ("é" * 70, 0.6), 6: ("don’t café", 0.85), 7: (None, None), 8: ("", 1.0), 9: ("é", 0.7), 10: ("ÂA é", 0.9),
    }


def test_rtf(spark):
    packed = bytes.fromhex("2d0000002b0000004c5a4675f1c5c7a703000a007263706731323542320af32068656c090020627705b06c647d0a800fa0")
    cases = {
        1: (packed, "hello world"),
        2: (rb"{\rtf1\ansi\ansicpg1252{\fonttbl{\f0 Arial;}}{\*\generator x;}A\'e9\par \b bold\b0 \u8364?\tab end\{\}}", "Aé\nbold€\tend{}"),
        3: (b"", ""),
        4: (None, None),
        5: (rb"{\rtf1 broken \'", "broken '"),
    }
    df = spark.createDataFrame([(i, r) for i, (r, _) in cases.items()], "i int, raw binary").select("i", rtf_text("raw").alias("t"))
    assert {r["i"]: r["t"] for r in df.collect()} == {i: t for i, (_, t) in cases.items()}


def test_stems(spark):
    want = {
        "caresses": "caress", "ponies": "poni", "cats": "cat", "feed": "feed", "agreed": "agre", "plastered": "plaster", "motoring": "motor", "sing": "sing", "conflated": "conflat", "hopping": "hop",
        "filing": "file", "happy": "happi", "sky": "sky", "relational": "relat", "digitizer": "digit", "triplicate": "triplic", "hopeful": "hope", "revival": "reviv", "adoption": "adopt",
        "controll": "control", "rate": "rate", "cease": "ceas", "cafés": "cafe", "x1": "x1", "generalizations": "gener", "oscillators": "oscil",
    }
    got = spark.createDataFrame([(w,) for w in want], "w string").select("w", stemmed(F.col("w")).alias("s")).collect()
    assert {r["w"]: r["s"] for r in got} == want
