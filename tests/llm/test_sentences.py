import pytest

from reviewloom.llm.sentences import sentence_starts, split_sentences

#: Sentences are parted by ⏎, which is no part of the text; a space or nothing stands there as written.
CASES = [
    "Delivery took 4 days, i.e. 3 days longer. ⏎It costs 3.50 dollars.",
    "They only ship within the U.S. ⏎My uncle agrees. ⏎Shipping from the U.S. warehouse is slow.",
    "Support closes at 9 p.m. ⏎The package came at 6 p.m. on a Friday.",
    "Dr. Orvask and J. Quandry met Mrs. Pelquist (see p. 42). ⏎Order no. 17 arrived.",
    '"Why does it beep?" asked my sister. ⏎"No refund," said the clerk. ⏎It broke.',
    '"WHY DOES IT BEEP?" ASKED MY SISTER. ⏎IT BROKE.',
    "My uncle returned it (the motor died!) and got 5 dollars. ⏎Really?! ⏎Yes.",
    "Honestly... the lid is fine. ⏎Nothing beats it... ⏎We like it.",
    "Wir haben z. B. die Lampe getestet. ⏎Das kam an, d. h. zu spät. ⏎Am 4. März kam Nr. 5 an.",
    "„Nie wieder“, sagte meine Tante. ⏎„Warum?“ fragte er. ⏎Ende.",
    "La lampe pèse 2,5 kg, c.-à-d. trop. ⏎Pourquoi ? ⏎« Plus jamais », dit-elle. ⏎M. Orvask répond.",
    "¿Por qué tarda? ⏎«No», dijo mi primo. ⏎La Sra. Orvask llegó a los 3 días, aprox. 4 tarde.",
    "客服说：“请再等9天。”⏎充电要1.5小时，太慢了！⏎为什么？",
    "「すぐ直ります。」と言われました。⏎なぜですか？⏎はい。",
    "ใช้งานได้32สัปดาห์แล้วเสีย ⏎สีสวยมาก",
    "وصل الطرد بعد 9 أيام. ⏎لماذا لا يغلق؟ ⏎نعم.",
    "डिब्बा देर से पहुँचा। ⏎क्या यह चलती है? ⏎हाँ।",
    "Size: L; Score: 2.5 of 5; Fit: loose. ⏎Would buy again.",
    "My kids adore it! ⏎Color: teal ; Size: M. ⏎It broke.",
    "*Support closes late.* ⏎_Not worth it._ ⏎“It broke.” ⏎(We like it.) ⏎Yes.",
    "You Get Screws, A Strap, Etc. ⏎Version 9 of the app fixed it.",
    "Shipping From The U.S. Warehouse Cost $5. ⏎Fine.",
    "I paid $4; they paid $5. ⏎if not, wait.",
    "It broke. ⏎exactly as described. ⏎The team (Mr.",
    "Sie ist eine kluge Frau. ⏎Der Mann kam spät. ⏎Fr. Orvask und Hr. Quandry sind nicht da.",
    "Je ne sais pas où il est. ⏎Il reviendra demain. ⏎M. Orvask et Mme. Quandry sont là, env. 3 jours.",
    "Subimos al. ⏎Después bajamos del col. ⏎El Dr. Orvask y la Sra. Quandry no están.",
    "The firm was founded est. 1990 by Orvask et al. in a shed. ⏎Col. Quandry and Gen. Pelquist met on Mt. Viskerley.",
    "He is a gen. ⏎Das ist ca. 5 Meter von der Straße weg. ⏎Der Rest ist gut.",
    "डॉ. शर्मा ने यह बॉक्स भेजा। ⏎यह अच्छा है।",
    "التقى د. خالد بالفريق. ⏎وصل الطرد.",
    "Siehe Abb. 3 und Kap. 4. ⏎Das ist die Art. ⏎Das war usw. nicht gut.",
]


@pytest.mark.parametrize("case", CASES)
def test_boundaries(case):
    pieces = case.split("⏎")
    want = [sum(map(len, pieces[:i])) for i in range(len(pieces))]
    assert sentence_starts("".join(pieces)) == want


def test_blank_and_odd_texts():
    assert sentence_starts(None) == sentence_starts("") == sentence_starts(" \n\t ") == []
    assert sentence_starts("  no stop") == [2]
    assert sentence_starts("!!!") == [0]
    assert sentence_starts("Good. 👍 👍") == [0]
    assert len(sentence_starts("One more. " * 30_000)) == 30_000


def test_operator(spark):
    df = spark.createDataFrame([(1, "Go on. Come in.", "x"), (1, "Go on. Come in.", "x"), (2, None, "y"), (3, "", "z")], "id int, text string, sentence string")
    out = split_sentences(df, "text", ["id"], with_text=True)
    assert [tuple(r) for r in out.orderBy("id", "sentence_no").collect()] == [(1, 0, 0, "Go on."), (1, 0, 0, "Go on."), (1, 1, 7, "Come in."), (1, 1, 7, "Come in.")]
    with pytest.raises(ValueError):
        split_sentences(df, "text", ["sentence"])
    assert split_sentences(df.limit(0), "text", ["id"]).count() == 0


def test_languages():
    from reviewloom.llm.sentences import _language

    cases = {"en": "The lid is broken and it leaks.", "de": "Der Deckel ist nicht gut.", "fr": "Le couvercle est pas dans la boîte.", "es": "La tapa es muy buena y el envío no.", "th": "ฝาปิดไม่สนิท", "hi": "यह बॉक्स", "ar": "الطرد", None: "Orvask 12"}
    assert {k: _language(t) for k, t in cases.items()} == {k: k for k in cases}
