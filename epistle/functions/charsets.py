"""Which legacy code page a text is in: byte-pair models, one for each language and page, trained here on the sentences below."""

from __future__ import annotations

import functools

import numpy as np

#: A few invented sentences a language, and the code pages that its mail was written in.
SENTENCES = {
    ("cp1252", "mac_roman"): [
        "Le dîner aura lieu à l'hôtel près de la gare, où nous avons déjà mangé l'été passé. J'espère que ça vous plaît; le garçon a été très aimable. Voilà les pièces jointes, merci à tous, à bientôt, André et Zoë.",
        "Können Sie die Unterlagen für die Prüfung bis nächsten Dienstag schicken? Die Größe der Räume hat sich geändert, über die Straße führt jetzt eine Brücke. Mit freundlichen Grüßen, Jürgen Müller, Geschäftsführer in Köln.",
        "La reunión será mañana por la mañana en el salón pequeño; mi compañera llegará después. ¿Podrías enviarme también el número de teléfono del señor Núñez? Aquí está la información que pedías, con el índice de cada página. ¡Qué alegría!",
        "A situação não está fácil, mas amanhã já teremos informações sobre a reunião. Vocês poderão ver as posições e as opções até à próxima sessão; três pães e um café são só para o João.",
        "Jag hörde att mötet är flyttat till på fredag eftermiddag; då får vi också träffa de nya från Göteborg. Hälsningar från Åsa och Björn. Det är svårt att förstå vad som ändå måste göras före året är över.",
        "Vi må også få på plass en løsning for bøker på høyden; kjære Bjørn, når går båten fra Tromsø? Få år før var både søster og far på øya, så vær så god og prøv.",
    ],
    ("cp1250", "iso8859_2"): [
        "Proszę przesłać dokumenty jeszcze dziś, ponieważ jutro będę cały dzień poza biurem. Dziękuję za pomoc i życzę miłego dnia. Książka leży na półce obok łóżka, a świeże pączki są w kuchni. Czy możesz mi powiedzieć, gdzie są źródła tych wiadomości?",
        "Příští týden se sejdeme v kanceláři, kde už budou připraveny všechny žádosti. Děkuji za zprávu, přeji hezký večer. Můžete mi říct, proč ještě nepřišly peníze za září? Měli bychom začít dříve než loni, když už víme, že účet je v pořádku.",
        "Kérem, küldje el a szükséges iratokat még e héten, mert később már nem lesz időnk rá. Köszönöm a gyors választ, üdvözlettel várjuk önöket. A könyvtár előtt állunk, ahol tegnap is találkoztunk; őszintén örülök, hogy végül minden sikerült.",
    ],
    ("cp1251", "koi8_r", "iso8859_5", "cp866"): [
        "Добрый день! Высылаю вам документы, о которых мы говорили вчера на совещании. Пожалуйста, проверьте их до пятницы и сообщите, если что-то нужно изменить. Мы будем рады видеть вас у нас в следующем месяце. С уважением, Елена Журавлёва.",
        "Прошу прислать новый список участников поездки и точное время отправления поезда. Хотелось бы ещё раз обсудить цену, условия и сроки; думаю, что это займёт не больше часа. Спасибо за помощь, до встречи в Москве.",
        "Сегодня утром пришло письмо от наших друзей: они собираются приехать летом и просят найти им жильё недалеко от моря. Я уже спросил хозяйку, есть ли свободная комната.",
    ],
    ("shift_jis", "euc_jp"): [
        "お世話になっております。来週の会議の資料を送りますので、ご確認ください。場所は東京の本社、時間は午後二時からの予定です。よろしくお願いいたします。",
        "先日はありがとうございました。メールの添付ファイルが開けませんでしたので、もう一度送っていただけますか。急がなくても大丈夫です。山田さんにも伝えてください。",
        "明日は雨が降るそうですから、電車で行くことにしました。駅に着いたら電話をかけます。それではまた後で。コンピュータのデータは月曜日までにバックアップします。",
    ],
    ("cp1253",): [
        "Καλημέρα σας, σας στέλνω τα έγγραφα για τη συνάντηση της επόμενης εβδομάδας. Παρακαλώ να μου απαντήσετε μέχρι την Παρασκευή, γιατί μετά θα λείπω. Ευχαριστώ πολύ για τη βοήθεια και την υπομονή σας.",
    ],
}
#: Weight of a byte's own frequency beside that of its pairs, and the least share that any byte has.
BACK, LEAST = 3.0, 0.02
#: A text is told where its pairs are this likely on average (natural logarithm), and this much more so than in the next page.
LIKELY, AHEAD = -5.2, 0.02
#: Fewer different pairs are no evidence, however often they come.
PAIRS = 4


def _high(a: np.ndarray) -> np.ndarray:
    return (a[:-1] >= 0x80) | (a[1:] >= 0x80)


def _table(texts: list[bytes]) -> np.ndarray:
    """log P(second byte | first byte) as a table of 256 by 256."""
    pairs, single = np.zeros((256, 256)), np.full(256, LEAST)
    for t in texts:
        a = np.frombuffer(t, np.uint8)
        np.add.at(pairs, (a[:-1], a[1:]), 1)
        np.add.at(single, a, 1)
    share = single / single.sum()
    return np.log((pairs + BACK * share) / (pairs.sum(axis=1, keepdims=True) + BACK))


@functools.cache
def models() -> list[tuple[str, np.ndarray]]:
    """(code page, table) for each language: pages of one script differ by which bytes they put the same letters on."""
    out = []
    for pages, texts in SENTENCES.items():
        for page in pages:
            for t in texts if len(pages) < 3 else ["\n".join(texts)]:
                out.append((page, _table([x.encode(page, "ignore") for x in (t, t.upper(), t)])))
    return out


def detected(raw: bytes) -> str | None:
    """The code page in which ``raw`` reads most like one of the languages; null where nothing does, or two do alike.

    Each pair with a byte above ASCII counts, over the whole text. Pages that cannot decode it are left out; pages in which
    it reads as the same characters are one.
    """
    a = np.frombuffer(raw, np.uint8)
    at = np.flatnonzero(_high(a)) if len(a) > 1 else np.array([], int)
    pairs, times = np.unique(a[at].astype(np.int32) * 256 + a[at + 1], return_counts=True) if len(at) else (at, at)
    if len(pairs) < PAIRS:
        return None
    best: dict[str, float] = {}
    for page, table in models():
        score = float(table.ravel()[pairs] @ times / times.sum())
        if score > best.get(page, -np.inf):
            best[page] = score
    found: list[tuple[float, str, str]] = []
    for page, score in sorted(best.items(), key=lambda x: -x[1]):
        try:
            text = raw.decode(page)
        except UnicodeDecodeError:
            continue
        if any(text == t for _, _, t in found):
            continue
        found.append((score, page, text))
        if len(found) == 2:
            break
    if not found or found[0][0] < LIKELY or (len(found) > 1 and found[0][0] - found[1][0] < AHEAD):
        return None
    return found[0][1]
