"""Token counts, toxicity, pseudonyms, licences and mixtures."""

import math
import random
import re
from collections import Counter

import pytest
from odd import LONG, TEXTS, documents, nothing
from pyspark.sql import functions as F

from parasol.llm import licenses, mixing, pii, tokens, toxicity

P = pytest.importorskip("public_tokenizers")


def test_token_counts_equal_the_library(spark):
    from tokenizers import Tokenizer
    library = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    pick = random.Random(3)
    parts = ["the", " the", "  ", "\n", "\t", "é", "1", "'s", " '", "<|endoftext|>", " <|endoftext|>", "<|endof", " x", " ",
             " —", " \n ", "😀", "\U0001e030", "漢", "²", "\r\n", "_", "-!", "\x1c", "\x85", "İ", "Ⅷ"]
    texts = ["".join(pick.choice(parts) for _ in range(pick.randint(0, 40))) for _ in range(1500)] + [t for _, t in TEXTS]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("n_tokens", F.lit("x"))
    got = {r.doc_id: (r.n_bytes, r.n_tokens) for r in tokens.token_counts(docs, P.path("byte_bpe_50k.json"), P.PATTERN).collect()}
    want = {i: (len((t or "").encode()), len(library.encode(t or "", add_special_tokens=False).ids)) for i, t in enumerate(texts)}
    assert got == want
    assert tokens.token_counts(nothing(spark), P.path("byte_bpe_50k.json"), P.PATTERN).count() == 0


def test_every_proven_string_is_one_token():
    from tokenizers import Tokenizer
    library = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    whole = tokens.whole_tokens(library)
    assert 40_000 < len(whole) < 50_257
    assert all(len(library.encode(t, add_special_tokens=False).ids) == 1 for t in random.Random(1).sample(sorted(whole), 2000))


def test_toxicity_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    found = toxicity.toxicity_scores(docs, labels).join(labels, "doc_id").where("held_out")
    right = found.agg(F.count_if((F.col("predicted") == 1) & (F.col("toxic") == 1)).alias("hit"), F.sum("toxic").alias("toxic"),
                      F.count_if((F.col("predicted") == 1) & (F.col("toxic") == 0)).alias("wrong"), F.count("*").alias("n")).first()
    assert right.hit >= 0.7 * right.toxic and right.wrong <= 0.05 * right.n


def by_hand(rows, text, fold=None, margin=0.0):
    """Summed differences of a text's words, per word and per root, from (text, toxic, fold) rows one by one."""
    bags = [(Counter(re.findall("[^\x00-\x60\x7b-\x7f]+", t)), toxic, f) for t, toxic, f in rows]
    contexts = Counter(w for bag, _, _ in bags for w in bag)
    logs = []
    for chosen in (True, False):
        n = Counter()
        for bag, toxic, f in bags:
            if toxic == chosen and f != fold:
                n.update({w: k.bit_length() for w, k in bag.items()})
        whole = sum(n.values())
        backoff = sum(min(k, 1.5) for k in n.values()) / whole

        def log_p(w, n=n, whole=whole, backoff=backoff):
            return math.log((max(n[w] - 1.5, 0) / whole + backoff * contexts[w] / sum(contexts.values())) / backoff)
        logs.append(log_p)
    total, words = 0.0, 0
    for w, k in Counter(re.findall("[^\x00-\x60\x7b-\x7f]+", text)).items():
        d = logs[0](w) - logs[1](w) if contexts[w] else 0.0
        total += k.bit_length() * math.copysign(max(abs(d) - margin, 0), d)
        words += k.bit_length()
    return total / max(words, 1), total / math.sqrt(max(words, 1))


def test_toxicity_equals_kneser_ney_by_hand(spark):
    pick = random.Random(8)
    common, vile = [f"wort{chr(97 + i)}" for i in range(20)] + ["ünï", "слово", "漢字"], ["scum", "vile", "гад"]
    rows = []
    for i in range(120):
        toxic = i % 3 == 0
        rows.append((" ".join(pick.choice(vile if toxic and pick.random() < .3 else common) for _ in range(pick.randint(0, 40))), toxic, i % 5))
    texts = [t for t, _, _ in rows[:40]] + ["", "scum", "unseen words", "scum " * 50, "worta " * 9 + "vile"]
    counts = toxicity.count_words(spark.createDataFrame(rows, "text string, toxic boolean, fold int"))
    words = toxicity.differences(counts).cache()
    for model, fold in ((2, 2), (toxicity.FOLDS, None)):
        asked = spark.createDataFrame([(i, t, model) for i, t in enumerate(texts)], "doc_id long, text string, model int")
        for shipped in (10**6, 0):  # both plans
            for r in toxicity.measures(asked, words, (0.0, 1.0), shipped).collect():
                for i, margin in enumerate((0.0, 1.0)):
                    assert (r.per_word[i], r.per_root[i]) == pytest.approx(by_hand(rows, texts[r.doc_id], fold, margin), abs=1e-9)


def test_toxicity_counts_keep_every_word_apart(spark):
    base = spark.range(60_000)
    letters = {"latin": "abcdefghij", "greek": "αβγδεζηθικ", "cyrillic": "абвгдежзик"}
    rows = None
    for i, alphabet in enumerate(letters.values()):
        words = F.concat_ws(" ", *[F.translate((base.id * 3 + k).cast("string"), "0123456789", alphabet) for k in range(3)])
        part = base.select(words.alias("text"), (F.lit(i) == 0).alias("toxic"), (base.id % 5).cast("int").alias("fold"))
        rows = part if rows is None else rows.union(part)
    counts = toxicity.count_words(rows)
    found = counts.agg(F.count("*"), F.max("contexts"), F.sum("contexts")).first()
    assert tuple(found) == (3 * 180_000, 1, 3 * 180_000)


def test_toxicity_by_either_plan(spark):
    sf = "/root/testdata/sf0.001"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    found = [{r.doc_id: r.score for r in toxicity.toxicity_scores(docs, labels, shipped_words=n).collect()} for n in (10**6, 0)]
    assert found[0] == pytest.approx(found[1], abs=1e-6)


def test_toxicity_learns_nothing_from_held_out_labels(spark):
    docs = documents(spark, clash=False)
    ids = [i for i in range(1, 40) if spark.range(1).select(F.crc32(F.lit(str(i)).cast("binary")) % 3).first()[0] == 1]
    labels = spark.createDataFrame([(i, 1) for i in ids], "doc_id long, toxic int")
    assert {r.score for r in toxicity.toxicity_scores(docs, labels).collect()} == {0.0}


def test_toxicity_of_odd_rows(spark):
    rows = [(100 + i, ("nice calm day " if i % 2 else "vile rotten scum ") * 5) for i in range(60)] + TEXTS
    labels = spark.createDataFrame([(100 + i, 1 - i % 2) for i in range(60)] + [(None, 1), (3, None), (100, 0)], "doc_id long, toxic int")
    docs = documents(spark, rows)
    found = toxicity.toxicity_scores(docs, labels).collect()
    assert len(found) == len(rows) and all(0 <= r.score <= 1 for r in found)
    kept = toxicity.drop_toxic(docs, labels)
    assert kept.columns == docs.columns
    left = {r.doc_id for r in kept.collect()}
    assert {3, 4, 5, 9} <= left and {101, 103} <= left and not {102, 104, 106} & left
    assert toxicity.drop_toxic(nothing(spark), labels).count() == 0
    assert toxicity.drop_toxic(docs, labels.limit(0)).count() == len(rows)


def luhn(digits):
    return sum(int(d) if i % 2 == 0 else sum(divmod(2 * int(d), 10)) for i, d in enumerate(reversed(digits))) % 10 == 0


VALUES = ["call +1 (586) 555-8430 or 586-555-8430, mail eai.84@mail7.example.com", "card 4227025300029028, 4227 0253 0002 9028, bad 4227025300029027",
          "ip 46.67.203.78 and 46.67.203.78. v 1.2.3", "born 1987-02-28, 28.02.1987, 28/02/1987, bad 1987-02-31", "ssn 123-45-6789 000-12-3456",
          "+49 30 1234567", None, "", "4227025300029028", 'token = "0641917ea4e9feb9cda83477b57ac2654884f485"', "a@b@c.de 2024-12-31x", LONG]


def test_pseudonyms_are_valid_linked_and_reversible(spark):
    docs = spark.createDataFrame(list(enumerate(VALUES)), "doc_id long, text string").withColumn("kinds", F.lit(1)).withColumn("new__", F.lit(1))
    hidden = pii.pseudonymise(docs, "key")
    got = [r.text for r in hidden.orderBy("doc_id").collect()]
    assert [r.text for r in pii.reveal(hidden, "key").orderBy("doc_id").collect()] == VALUES
    assert got[6] is None and got[7] == "" and got[9] == VALUES[9] and got[11] == LONG
    cards = re.findall(r"4\d{15}|4\d{3} \d{4} \d{4} \d{4}", got[1])
    assert cards[0] == cards[1].replace(" ", "") == got[8] != "4227025300029028" and luhn(cards[0]) and "4227025300029027" in got[1]
    dates = re.search(r"born (\d{4})-(\d\d)-(\d\d), (\d\d)\.(\d\d)\.(\d{4}), (\d\d)/(\d\d)/(\d{4}), bad 1987-02-31", got[3]).groups()
    assert (dates[0], dates[1], dates[2]) == (dates[5], dates[4], dates[3]) == (dates[8], dates[7], dates[6])
    phones = re.search(r"call \+1 \((\d{3})\) (\d{3}-\d{4}) or (\d{3})-(\d{3}-\d{4}), mail (\S+)@mail7.example.com", got[0]).groups()
    assert phones[:2] == phones[2:4] and phones[:2] != ("586", "555-8430") and phones[4] != "eai.84"
    addresses = re.findall(r"\d+\.\d+\.\d+\.\d+", got[2])
    assert addresses[0] == addresses[1] != "46.67.203.78" and "000-12-3456" in got[4] and "123-45-6789" not in got[4]
    assert pii.pseudonymise(nothing(spark), "key").count() == 0


FORMS = ["4227025300029028 12/25", "4227025300029028 123", "4227025300029028", "4227 0253 0002 9028 123", "12 4227025300029028 x",
         "4227-0253-0002-9028", "12/25/2020 25.12.2020 2020/12/25 2020-12-25 25/12/2020", "3.4.2020 03.04.2020 3/4/2020 2020/4/3",
         "30.2.2020 0/1/2020 13/13/2020", "29.02.2020 11/10/2020", "+44 1234 1234 1234 1234 1234"]


def feistel(value, a, b, tweak, key):
    from hashlib import sha256
    left, right = divmod(value, b)
    for i in range(1, pii.ROUNDS + 1):
        mixed = int(sha256(f"{key}:{tweak}:{i}:{right}".encode()).hexdigest()[:14], 16)
        left, right = right, (left + mixed) % (a if i % 2 else b)
    return left * b + right


def test_every_way_of_writing_a_value_gives_one_pseudonym(spark):
    docs = spark.createDataFrame(list(enumerate(FORMS)), "doc_id long, text string")
    hidden = pii.pseudonymise(docs, "key")
    got = [r.text for r in hidden.orderBy("doc_id").collect()]
    head = f"4{feistel(22702530002902, 10 ** 7, 10 ** 7, 'card/14', 'key'):014d}"
    card = next(head + c for c in "0123456789" if luhn(head + c))
    fours = [card[i:i + 4] for i in range(0, 16, 4)]
    assert got[:6] == [card + " 12/25", card + " 123", card, " ".join(fours) + " 123", f"12 {card} x", "-".join(fours)]
    day = got[6].split()[3].split("-")
    assert got[6] == "{1}/{2}/{0} {2}.{1}.{0} {0}/{1}/{2} {0}-{1}-{2} {2}/{1}/{0}".format(*day) and day != ["2020", "12", "25"]
    value = (220 * 3 + 2) * 19 + 12
    for _ in range(400):  # past days that are none
        value = feistel(value, 400 * 3, 19, "date/13/10", "key")
        y, m, d = value // 57 + 1800, value // 19 % 3 + 10, value % 19 + 13
        if not (m == 11 and d == 31):
            break
    assert day == [str(y), str(m), str(d)]
    y, m, d = got[7].split()[3].split("/")
    assert got[7] == f"{d}.{m}.{y} 0{d}.0{m}.{y} {d}/{m}/{y} {y}/{m}/{d}" and got[8] == FORMS[8] and got[10] != FORMS[10]
    assert [r.text for r in pii.reveal(hidden, "key").orderBy("doc_id").collect()] == FORMS


def test_columns_with_the_operators_own_names_pass(spark):
    docs = spark.createDataFrame([(1, "4227025300029028", "a", "b", "c", "d")], "doc_id long, body string, found__ string, new__ string, woven__ string, text string")
    row = pii.pseudonymise(docs, "key", text_col="body").first()
    assert row[0] == 1 and row.body != "4227025300029028" and row[2:6] == ("a", "b", "c", "d") and row.kinds == "card"


@pytest.mark.parametrize("a,b", [(1, 10), (7, 13), (189, 773)])
def test_feistel_is_a_permutation(spark, a, b):
    n = a * b
    col = pii._feistel(F.col("id"), F.lit(a).cast("bigint"), F.lit(b).cast("bigint"), F.lit("t"), "k", False)
    rows = spark.range(n).select("id", col.alias("new"))
    assert sorted(r.new for r in rows.collect()) == list(range(n))


def test_no_personal_value_of_the_table_stays(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    after = pii.pseudonymise(docs, "key").select("doc_id", F.col("text").alias("after"))
    for before, new in docs.join(after, "doc_id").select("text", "after").collect():
        for value in re.findall(r"\S+@\S+\.com|\+1 \(\d{3}\) \d{3}-\d{4}|(?<!\w)4\d{15}(?!\w)", before):
            assert value not in new or re.match(r"4\d{15}$", value) and not luhn(value)


def test_licences_and_their_directories(spark):
    rows = [("a/LICENSE", "Released under the MIT License."), ("a/x.txt", "some prose here\nand there"), ("a/b/y.txt", "more prose"),
            ("a/b/LICENSE", "Licensed under the Apache License, Version 2.0."), ("a/b/c/z.txt", None), ("w.txt", "prose"), (None, "prose"),
            ("q/own.txt", "prose\n" * 30 + "This work is licensed under the GNU General Public License, version 3.\n" + "prose " * 50), ("q/r.txt", ""),
            ("a/x.txt", "some prose here\nand there"), ("w2.txt", LONG)]
    docs = spark.createDataFrame([(i, p, t) for i, (p, t) in enumerate(rows)], "doc_id long, path string, text string").withColumn("line", F.lit(1))
    got = {r.doc_id: (r.license, r.inherited_from) for r in licenses.license_scan(docs).collect()}
    assert got == {0: ("MIT", None), 1: ("MIT", "a"), 2: ("Apache-2.0", "a/b"), 3: ("Apache-2.0", None), 4: ("Apache-2.0", "a/b"),
                   5: (None, None), 6: (None, None), 7: ("GPL-3.0", None), 8: (None, None), 9: ("MIT", "a"), 10: (None, None)}
    assert licenses.license_scan(docs.limit(0)).count() == 0


GPL_HEADER = """#!/usr/bin/env tool
# This program is free software: you can redistribute it and/or modify it
# under the terms of the GNU General Public License as published by
# the Free Software Foundation, either version 3 of the License, or
# (at your option) any later version.
import things
from there import more
and so on to the end of it
"""


def wrapped(text, width, before=""):
    import textwrap
    return "\n".join(before + x for x in textwrap.wrap(text, width))


def test_headers_and_whole_licence_files(spark):
    mit = "MIT License\n\nCopyright (c) 2020 Someone\n\n" + "\n\n".join(wrapped(x, 70) for x in licenses._MIT) + "\n"
    apache = "/*\n" + "\n *\n".join(wrapped(x, 60, " * ") for x in licenses._APACHE) + "\n */\nclass A {}\n" + "code here and there\n" * 40
    gpl = "                    GNU GENERAL PUBLIC LICENSE\n                       Version 3, 29 June 2007\n\n" + "long terms follow here\n" * 300
    rows = [("p/LICENSE", mit), ("p/a.py", "some prose"), ("q/b.py", GPL_HEADER + "more code\n" * 60), ("q/c.py", "prose"), ("r/A.java", apache),
            ("s/COPYING", gpl), ("s/t/u.c", "int main"), ("v/text", mit.replace("\n\n", "\n")), ("v/w", "x"), ("y/LICENSE", "nothing of the kind"), ("y/z", "")]
    docs = spark.createDataFrame([(i, p, t) for i, (p, t) in enumerate(rows)], "doc_id long, path string, text string").withColumn(
        "kind", F.lit(1)).withColumn("folder", F.lit(1))
    got = {r.path: (r.own_license, r.is_license_file, r.license, r.inherited_from) for r in licenses.license_scan(docs).collect()}
    assert got == {
        "p/LICENSE": ("MIT", True, "MIT", None), "p/a.py": (None, False, "MIT", "p"), "q/b.py": ("GPL-3.0", False, "GPL-3.0", None),
        "q/c.py": (None, False, None, None), "r/A.java": ("Apache-2.0", False, "Apache-2.0", None), "s/COPYING": ("GPL-3.0", True, "GPL-3.0", None),
        "s/t/u.c": (None, False, "GPL-3.0", "s"), "v/text": ("MIT", True, "MIT", None), "v/w": (None, False, "MIT", "v"),
        "y/LICENSE": (None, False, None, None), "y/z": (None, False, None, None)}


def own_by_hand(rows):
    import math
    from collections import Counter
    frequencies = Counter(t for _, text in rows for t in set(licenses.terms(text or "")))
    idf = lambda t: math.log((1 + len(rows)) / (1 + frequencies[t])) + 1
    vector = lambda text: {t: n * idf(t) for t, n in Counter(licenses.terms(text)).items()}
    norm = lambda v: math.sqrt(sum(w * w for w in v.values()))
    templates = [(name.split("/")[0], vector(text)) for name, text in licenses.ALL_TEMPLATES.items()]
    found = {}
    for i, text in rows:
        lines = (text or "").split("\n")
        kinds = [0 if not re.search("[A-Za-z0-9]", x) else 2 if re.match(licenses.COMMENT, x) else 1 for x in lines]
        passages = ["\n".join(lines[a:a + k]) for a in range(len(lines)) for k in range(1, licenses.RUN_LINES + 1) if a + k <= len(lines)]
        begins = [a for a in range(len(lines)) if not a or kinds[a] != kinds[a - 1]]
        passages += ["\n".join(lines[a:b]) for a, b in zip(begins, begins[1:] + [len(lines)])]
        best = None
        for v in filter(None, map(vector, passages)):
            for name, t in templates:
                cosine = round(sum(w * t.get(x, 0) for x, w in v.items()) / norm(v) / norm(t), 6)
                if cosine >= licenses.THRESHOLD and (best is None or (-cosine, name) < best):
                    best = (-cosine, name)
        found[i] = best and (best[1], -best[0])
    return found


def test_scan_equals_cosines_by_hand(spark):
    pick = random.Random(11)
    words = " ".join(licenses.ALL_TEMPLATES.values()).split() + "some other words of prose that stand around".split()
    rows = [(0, None), (1, ""), (2, GPL_HEADER), (3, GPL_HEADER)]
    for i in range(4, 120):
        text = pick.choice(list(licenses.ALL_TEMPLATES.values())).split()
        text = [pick.choice(words) if pick.random() < 0.25 else w for w in text if pick.random() < 0.85] if i % 3 else pick.choices(words, k=60)
        mark, breaks = pick.choice(["", "", "# ", " * "]), pick.choice([0.05, 0.15, 0.3])
        text = "".join(w + (pick.choice(["\n", "\n", "\n\n"]) + mark if pick.random() < breaks else " ") for w in text)
        rows.append((i, pick.choice(["", "some prose\n", "code here\n\n"]) + mark + text + pick.choice(["", "\ncode there"])))
    docs = spark.createDataFrame([(i, f"{i}/f", t) for i, t in rows], "doc_id long, path string, text string")
    got = {r.doc_id: r.own_license and (r.own_license, r.own_cosine) for r in licenses.license_scan(docs).collect()}
    want = own_by_hand(rows)
    assert sum(x is not None for x in want.values()) > 40
    for i in want:
        assert (got[i] is None) == (want[i] is None) and (want[i] is None or got[i][0] == want[i][0] and abs(got[i][1] - want[i][1]) < 2e-6), i


def test_common_words_beside_a_notice_weigh_little(spark):
    for n in (50, 1000):
        rows = [(0, "d/f", "prose\nReleased under the MIT License, see the file for details you may have.\n" + "prose\n" * 50)]
        rows += [(i, f"{i}/f", "for details you may see the file we have") for i in range(1, n)]
        docs = spark.createDataFrame(rows, "doc_id long, path string, text string")
        found = {r.doc_id: r.own_license for r in licenses.license_scan(docs).where("own_license is not null").collect()}
        assert found == {0: "MIT"}


def test_every_template_names_its_own_licence(spark):
    rows = [(i, f"{i}/f", "words before\n" + text) for i, text in enumerate(licenses.TEMPLATES.values())]
    docs = spark.createDataFrame(rows, "doc_id long, path string, text string")
    found = {r.doc_id: (r.own_license, r.own_cosine) for r in licenses.license_scan(docs).collect()}
    assert [found[i][0] for i in range(len(rows))] == list(licenses.TEMPLATES) and all(c > 0.999 for _, c in found.values())


def test_anchors_lose_no_line(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").withColumn("path", F.lit("d/f"))
    vectors, idf, anchors = licenses.template_vectors(1000, {"the": 900, "license": 40, "under": 40}, 0.7)
    for name, text in licenses.TEMPLATES.items():
        rest = {t: w for t, w in vectors[name].items() if t not in anchors}
        assert sum(w * w for w in rest.values()) < 0.49
    found = licenses.license_scan(docs).where("own_license is not null").count()
    assert found == docs.where(F.col("text").rlike(r"(?m)^(Released under the MIT|Licensed under|This work is licensed)")).count()


def test_raked_weights_meet_every_margin(spark):
    pick = random.Random(5)
    cells = [(f"s{a}", f"l{b}", f"t{c}", pick.randint(0, 500)) for a in range(5) for b in range(3) for c in range(2)]
    frame = spark.createDataFrame(cells, "source string, lang string, topic string, tokens long")
    targets = {m: mixing.tempered(frame, m, 0.5) for m in mixing.MARGINS}
    fitted = mixing.rake(frame, targets, 20).withColumn("w", F.col("tokens") * F.col("factor"))
    for m, t in targets.items():
        rows = fitted.groupBy(m).agg(F.sum("w").alias("w")).join(t, m).collect()
        assert rows and all(r.w == pytest.approx(r.target, rel=1e-6) for r in rows)


def test_mixture_of_odd_rows(spark):
    docs = documents(spark).withColumn("lang", F.when(F.col("doc_id") == 1, None).otherwise(F.col("lang")))
    found = mixing.mixture(docs)
    rows = found.collect()
    assert len(rows) == len(TEXTS) and all(0 < r.probability <= 1 for r in rows)
    assert {r.n_tokens for r in rows if r.text is None} == {0}
    assert all(r.cell_source == r.source__ == r.lang__ == str(len(r.text or "")) for r in rows)
    assert mixing.mixture(nothing(spark)).count() == 0
