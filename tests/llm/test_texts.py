"""p8, p9, p10: leaked passages, mixes, wrongly decoded text."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tarsus.llm import encoding, leakage, mixing

RNG = random.Random(8)
DOCS = "doc_id bigint, text string, source string, _id string, _text string, item_id string, tokens string, start string"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, s, "c", "c", "c", "c", "c") for i, t, s in rows], DOCS)


def items(spark, rows):
    return spark.createDataFrame([(i, t, "suite") for i, t in rows], "item_id bigint, text string, suite string")


def words(n, of=400):
    return [f"w{RNG.randrange(of)}" for _ in range(n)]


def test_leaks_against_brute_force(spark, rows):
    tests = [(i, " ".join(words(RNG.randint(5, 40), 60))) for i in range(12)] + [(20, None), (21, ""), (22, "one two")]
    data = []
    for i in range(80):
        t = words(RNG.randint(0, 60), 60)
        if i % 2 and (w := (tests[RNG.randrange(12)][1]).split()):
            a = RNG.randrange(len(w))
            part = w[a : a + RNG.randint(8, 20)]
            t[5:5] = [x.upper() for x in part]
        data.append((i, RNG.choice([" ", "--", "\n", " _ ", ",\t"]).join(t), "s"))
    data += [(100, None, "s"), (101, "", "s"), (None, tests[0][1], "s"), data[1]]
    split = lambda t: re.findall(r"[^\W_]+", (t or "").lower())
    want = set()
    for i, t, _ in data:
        d = " " + " ".join(split(t)) + " "
        for j, q in tests:
            w = split(q)
            if i is not None and any(" " + " ".join(w[a : a + 12]) + " " in d for a in range(len(w) - 11)):
                want.add((i, j))
    for block_words in (2_000_000, 100):
        got = leakage.leaked_spans(docs(spark, data), items(spark, tests), block_words=block_words).select("doc_id", "item_id").distinct()
        assert set(rows(got)) == want and got.count() == len(want)
    assert leakage.leaks(docs(spark, []), items(spark, [])).count() == 0


def test_spans_are_maximal_and_cut_out(spark):
    test = " ".join(f"t{i}" for i in range(30))
    text = "Before, " + "; ".join(f"T{i}" for i in range(3, 20)) + " - after " + "x " * 200
    s = leakage.leaked_spans(docs(spark, [(1, text, "s")]), items(spark, [(7, test)])).first()
    assert (s.item_word, s.words, text[s["start"] : s["end"]][:3], text[s["start"] : s["end"]][-3:]) == (3, 17, "T3;", "T19")
    c = leakage.cleaned(docs(spark, [(1, text, "s"), (2, test, "s")]), items(spark, [(7, test)])).orderBy("doc_id").collect()
    assert c[0].text.startswith("Before,  - after") and c[1].text is None
    assert leakage.leaked_items(docs(spark, [(1, text, "s")]), items(spark, [(7, test), (8, "x")])).orderBy("item_id").collect()[0].longest == 17


def test_very_long_text(spark):
    test = " ".join(f"t{i}" for i in range(14))
    text = "t3 t4 " * 200_000 + test
    assert leakage.leaks(docs(spark, [(1, text, "s")]), items(spark, [(7, test)])).count() == 1


def test_pivot_keeps_tokens():
    rng = np.random.default_rng(5)
    for _ in range(50):
        n = rng.integers(1, 60)
        tokens, part = rng.integers(1, 1000, n).astype(float), rng.random(n)
        out = mixing.pivot(tokens, part, rng.random(n))
        inner = (out > 1e-6) & (out < 1 - 1e-6)
        assert inner.sum() <= 1 and ((out >= 0) & (out <= 1)).all()
        assert abs((tokens * out).sum() - (tokens * part).sum()) < 1e-3 * tokens.sum()


def test_pivot_is_fair():
    rng = np.random.default_rng(6)
    tokens, part = np.array([10.0, 20.0, 30.0, 15.0]), np.array([0.3, 0.6, 0.2, 0.5])
    mean = np.mean([mixing.pivot(tokens, part, rng.random(4)) for _ in range(4000)], axis=0)
    assert np.abs(mean - part).max() < 0.04


@pytest.mark.parametrize("block_rows", [20_000, 2])
def test_mix(spark, block_rows):
    text = "the reeds were quiet before the rain came over the water "
    data = [(i, text * RNG.randint(1, 4), "big") for i in range(150)] + [(500 + i, text, "small") for i in range(10)] + [(700, text, "untargeted"), (701, None, "big"), (702, "", "big"), (703, text, None), (None, text, "big"), (0, text, "big")]
    targets = spark.createDataFrame([("big", 0.7, 1), ("small", 0.2, 3), ("absent", 0.1, 2), (None, 0.1, 1)], "source string, target_share double, max_repeats int")
    mix, plan = mixing.draw_mix(docs(spark, data), targets, block_rows=block_rows)
    got = mix.collect()
    assert {r.source for r in got} == {"big", "small"} and all(1 <= r.copies <= (3 if r.source == "small" else 1) for r in got)
    assert len({r.doc_id for r in got}) == len(got) and mix.exceptAll(mixing.draw_mix(docs(spark, data), targets, block_rows=block_rows)[0]).isEmpty()
    report = {r.source: r for r in mixing.mix_report(mix, plan).collect()}
    longest = max(r.tokens for r in got)
    for s in ("big", "small"):
        assert abs(report[s].tokens - report[s].target_tokens) <= longest
    assert report["absent"].tokens == 0 and abs(report["small"].actual_share - 2 / 9) < 0.05


def test_empty_mix(spark):
    targets = spark.createDataFrame([("a", 1.0, 1)], "source string, target_share double, max_repeats int")
    mix, plan = mixing.draw_mix(docs(spark, []), targets)
    assert mix.count() == 0 and mixing.mix_report(mix, plan).first().actual_share == 0.0


CLEAN = [
    "Schnabel kräftig, Füße gelblich, Augenring schmal und weiß.", "À 7:20, la température était tombée à 12 °C et la brume couvrait déjà l’étang.", "¿Será una cría de Shorebill? La niebla cubrió la orilla.",
    "Rows were dropped – 16 in all – before the split. Ring “C77K” was read at the frame’s edge.", "Pokój 41, żurawie i łąki", "Σταθμός 22: Mudstalker", "Станция: запись", "SÃO ALTA: lista, ESTAÇÃO DE CONTAGEM – Øvre", "plain ascii text",
]


@pytest.mark.parametrize("text", CLEAN)
def test_clean_text_stays(text):
    assert encoding.repair(text) == (text, False, True)


@pytest.mark.parametrize("text", CLEAN[:4])
@pytest.mark.parametrize("read", ["cp1252", "latin-1", "mac_roman", "cp437", "cp850", "cp1250", "cp1251"])
@pytest.mark.parametrize("layers", [1, 2])
def test_round_trip(text, read, layers):
    def wrong(t):
        back = {b: c for c, b in encoding.byte_table(read).items()}
        return "".join(back.get(b, chr(b)) for b in t.encode("utf-8"))

    garbled = text
    for _ in range(layers if read in ("cp1252", "latin-1") else 1):
        garbled = wrong(garbled)
    now, found, complete = encoding.repair("Clean before. " + garbled)
    assert found and complete and now == "Clean before. " + text


@pytest.mark.parametrize("text", ["Le plumage de l’oiseau paraissait plus foncé qu’à l’été précédent.", "Pegel 15 cm, Schütz 65 geöffnet. Himmel bewölkt."])
def test_one_byte_confusion(text):
    garbled = text.encode("mac_roman").decode("cp1252", errors="replace").replace(encoding.LOSS, "\x8f")
    now, found, _ = encoding.repair(garbled)
    assert found and now == text


@pytest.mark.parametrize("text", ["Release note 10: names that showed up as “Ã©” or “Ã¼” in the label list now display properly.", "Reminder: if you see â€™ where an apostrophe belongs, the viewer is set to the wrong code page.", "The importer rejects rows whose label contains the mark �, see rule 75."])
def test_signs_shown_on_purpose(text):
    assert encoding.repair(text)[1] is False
    assert encoding.repair(text + " Himmel bewÃ¶lkt.")[:2] == (text + " Himmel bewölkt.", True)


def test_lost_characters_are_found_not_invented():
    assert encoding.repair("Charge 22 enth�lt 87 Bilder.") == ("Charge 22 enth�lt 87 Bilder.", True, False)


def test_documents(spark, rows):
    long = "Himmel bewölkt. " * 20_000
    data = [(1, "bewÃ¶lkt", "s"), (1, "bewÃ¶lkt", "s"), (2, None, "s"), (3, "", "s"), (4, "fine", "s"), (5, long + "FÃ¼ÃŸe", "s"), (None, "bewÃ¶lkt", "s"), (6, "enth�lt", "s")]
    got = {r.doc_id: (r.restored_text, r.complete) for r in encoding.repaired_documents(docs(spark, data)).collect()}
    assert got == {1: ("bewölkt", True), 5: (long + "Füße", True), 6: ("enth�lt", False)}
    assert encoding.repaired_documents(docs(spark, []).withColumn("x", F.lit(1))).count() == 0


@pytest.mark.parametrize("layers", range(1, 8))
def test_any_number_of_layers(layers):
    text = garbled = "Der Graureiher blüht früh, naïve café"
    for _ in range(layers):
        garbled = garbled.encode().decode("latin-1")
    assert encoding.repair(garbled) == (text, True, True)


@pytest.mark.parametrize(
    "text,intended,read",
    [
        ("Привет мир, как дела", "utf-8", "cp1251"), ("שלום עולם", "utf-8", "latin-1"), ("สวัสดีชาวโลก", "utf-8", "latin-1"), ("Tiếng Việt rất hay", "utf-8", "latin-1"), ("日本語テキスト", "utf-8", "latin-1"),
        ("مرحبا بالعالم", "utf-8", "latin-1"), ("Привет мир, как дела", "koi8_r", "latin-1"), ("Привет мир, как дела", "cp1251", "latin-1"), ("한국어 문장입니다", "euc_kr", "latin-1"), ("Καλημέρα κόσμε", "cp1253", "latin-1"),
    ],
)
def test_other_scripts(text, intended, read):
    assert encoding.repair(text) == (text, False, True)
    assert encoding.repair(text.encode(intended).decode(read))[:2] == (text, True)


def test_what_stays_out_of_place_is_not_complete():
    both = "Ein Zaunkönig sang.".encode().decode("latin-1") + " gr\x9aße"
    text, garbled, complete = encoding.repair(both)
    assert text.startswith("Ein Zaunkönig") and garbled and not complete


def test_last_open_document_is_drawn_fairly(spark):
    table = docs(spark, [(1, "a b c", "s"), (2, "a b c", "t"), (3, "a b c", "t"), (4, "a b c", "t"), (5, "a b c", "t")])
    targets = spark.createDataFrame([("s", 0.1, 1), ("t", 0.9, 1)], "source string, target_share double, max_repeats int")
    drawn = [sum(r.source == "s" for r in mixing.draw_mix(table, targets, seed=seed)[0].collect()) for seed in range(12)]
    assert 0 < sum(drawn) < 12  # expected 4/9 of a copy


def test_both_kinds_of_tokenizer_count_alike(spark, rows):
    table = docs(spark, [(1, "Zaunkönig <|endoftext|> 12", "s"), (2, None, "s"), (3, "it's  here\n", "s")])
    got = [rows(mixing.token_counts(table, mixing.TOKENIZER.replace(".tiktoken", end))) for end in (".tiktoken", ".json")]
    assert got[0] == got[1] and [r[2] for r in got[0]][1] == 0
