"""Code pages told apart on sentences that no model has seen."""

from epistle.functions.charsets import detected
from epistle.functions.repair import decoded

HELD = {
 "cp1252": ["Nous n'avons pas reçu votre réponse à temps; la société a dû reporter l'événement à une date ultérieure. Désolée pour le désagrément.",
   "Bitte prüfen Sie, ob die Lieferung vollständig ist. Für Rückfragen stehe ich Ihnen natürlich gern zur Verfügung, schöne Grüße aus München.",
   "Está previsto que el avión salga a las siete. El año pasado también llovió en otoño, así que llévate un jersey más grueso y un paraguas más ancho.",
   "Kan du köpa mjölk och bröd på vägen hem? Vi äter klockan sju, och sedan går vi på bio med Märta och Göran.",
   "Ontem à noite a minha irmã não conseguiu ligar; o telefone está avariado há três dias e a reparação só começa amanhã."],
 "cp1250": ["Wczoraj wieczorem byliśmy w kinie, a później poszliśmy na kolację. Następnym razem zadzwonię wcześniej, żebyś mógł przyjść.",
   "Zítra ráno přijede můj bratr z Brna, takže nebudu mít čas. Napiš mi prosím, jestli ti vyhovuje čtvrtek nebo až příští pondělí.",
   "Tegnap este nagyon későn értünk haza, ezért csak ma tudok válaszolni. Remélem, hogy a gyerekek jól érezték magukat nálunk."],
 "cp1251": ["Вчера вечером мы ходили в театр, а потом долго гуляли по городу. Позвони мне, когда вернёшься домой, я хочу рассказать тебе новости.",
   "Уважаемые коллеги, напоминаем, что отчёты за квартал необходимо сдать не позднее двадцатого числа."],
 "koi8_r": ["Вчера вечером мы ходили в театр, а потом долго гуляли по городу. Позвони мне, когда вернёшься домой.", "Уважаемые коллеги, напоминаем, что отчёты за квартал необходимо сдать не позднее двадцатого числа."],
 "shift_jis": ["昨日の夜、友達と映画を見に行きました。とても面白かったです。今度は一緒に行きましょう。時間があるときに連絡してください。", "ご注文の商品は本日発送いたしました。到着まで三日ほどかかります。ご不明な点がございましたらお問い合わせください。"],
 "euc_jp": ["昨日の夜、友達と映画を見に行きました。とても面白かったです。今度は一緒に行きましょう。時間があるときに連絡してください。"],
 "cp1253": ["Χθες το βράδυ πήγαμε στον κινηματογράφο και μετά φάγαμε μαζί με τους φίλους μας κοντά στη θάλασσα."],
}


def pieces(page: str, text: str, least: int) -> list[bytes]:
    """The text in pieces of at least so many bytes, cut between words (or characters, where none are marked)."""
    gap = "" if page in ("shift_jis", "euc_jp") else " "
    out, now = [], b""
    for w in text.split(" ") if gap else text:
        now += (gap + w).encode(page)
        if len(now) >= least:
            out, now = [*out, now], b""
    return [p for p in out if not p.isascii()]


def accuracy(least: int | None) -> float:
    raw = [(page, p) for page, texts in HELD.items() for t in texts for p in (pieces(page, t, least) if least else [t.encode(page)])]
    return sum((e := detected(p)) is not None and p.decode(e) == p.decode(page) for page, p in raw) / len(raw)


def test_whole_sentences_and_pieces():
    assert accuracy(None) == 1.0
    assert accuracy(64) >= 0.95
    assert accuracy(32) >= 0.85


def test_what_is_no_evidence():
    assert [detected(x) for x in (b"", b"plain", b"\xe9", ("é" * 70).encode("cp1252"), bytes(range(128, 256)), bytes((k * 37 + k * k) % 128 + 128 for k in range(400)))] == [None] * 6


def test_ladder(spark):
    rows = [(page, k, t.encode(page), t) for page, texts in HELD.items() for k, t in enumerate(texts)]
    df = spark.createDataFrame([(*r[:3], None) for r in rows], "page string, k int, raw binary, declared string")
    got = {(r["page"], r["k"]): (r["d"]["text"], r["d"]["confidence"]) for r in df.select("page", "k", decoded("raw", "declared").alias("d")).collect()}
    assert got == {(page, k): (t, 0.8) for page, k, _, t in rows}
