import re
from collections import Counter
from pathlib import Path

from pyspark.sql import functions as F

from siltstone.llm import licenses, rules
from tests.llm.helpers import documents, texts

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def measured(t):
    words = WORD.findall(t or "")
    lines = [x for x in (t or "").split("\n") if WORD.search(x)]
    wins = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    twice = {w for w, c in Counter(wins).items() if c > 1}
    hit = {i + j for i, w in enumerate(wins) if w in twice for j in range(8)}
    pairs = Counter(zip(words, words[1:])).values()
    more = sum(any(c.isalpha() for c in w) for w in words), sum(bool(re.match(r"[ \t]*[•‣▪*\-]", x)) for x in lines), sum(bool(re.search(r"(\.\.\.|…)[ \t\r]*\Z", x)) for x in lines), len({w.lower() for w in words} & set(rules.STOP_WORDS)), max(pairs, default=0)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in t or ""), len(lines) - len(set(lines)), len(hit), *more


def test_ledger_equals_brute_force(spark):
    nine = "a b c d e f g h i"
    rows = [*enumerate(texts()), (20, nine), (21, f"{nine} {nine}"), (22, f"{nine} x {nine} y {nine}"), (23, "q " * 9), (24, "l\nl\n\nl"), (25, "# * $ a!! b!!"), (26, "- one\n * two\nthree...\nThe of… \n... x"), (None, "x")]
    docs = documents(spark, rows).withColumn("words", F.lit(1)).withColumn("failed", F.lit(2))
    got = rules.ledger(docs).collect()
    assert sorted((str(r.doc_id), r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.n_letter_words, r.n_bullet_lines, r.n_ellipsis_lines, r.n_stop_words, r.n_top_pair) for r in got) == sorted((str(d), *measured(t)) for d, t in rows)


def test_policies_and_ablations(spark):
    rows = [(1, "the good of words " + " ".join(f"w{i}" for i in range(40))), (2, "short"), (3, "s " * 50), (4, " ".join(f"w{i}###" for i in range(40))), (5, "A!! B!!")]
    held = rules.ledger(documents(spark, rows))
    kept = {r.doc_id for r in rules.verdicts(held).where("kept").collect()}
    assert kept == {1}
    table = {r.rule: r for r in rules.ablations(held).collect()}
    masked = {r.doc_id: r.failed & rules.mask(rules.POLICIES[rules.CURRENT]) for r in held.collect()}
    for rule in rules.POLICIES[rules.CURRENT]:
        bit = rules.mask([rule])
        assert table[rule].n_failed == sum(bool(b & bit) for b in masked.values())
        assert table[rule].n_only_it == sum(b == bit for b in masked.values())
        assert table[rule].n_kept_without == sum(not b & ~bit for b in masked.values())


def test_empty_ledger(spark):
    assert rules.ledger(documents(spark, [])).count() == 0


def published(name):
    return (Path(licenses.__file__).parent / "license_texts" / f"{name}.txt").read_text(encoding="utf-8")


def test_scan_finds_units_only(spark):
    mit, apache = published("MIT"), published("Apache-2.0")
    body = mit.split("\n\n", 2)[2]
    header = next(t for n, t in licenses.KNOWN if n == "Apache-2.0" and len(t) > 200)
    rows = [
        (1, mit), (2, "Copyright (c) 2020 A. Person\nAll rights reserved.\n\n" + body.upper().replace(" ", "  ")), (3, "Some prose.\n\n" + body + "\n\nMore prose."),
        (4, "first\n  licensed under CC-BY NC 4.0 \nlast"), (5, "We licensed under CC BY-NC 4.0 our work."), (6, "This program may favour merchantibility."),
        (7, None), (8, ""), (None, "Released under the MIT Licence"), (9, "x " * 5000), (10, "".join(f"# {x}\n" for x in header.split("\n")) + "\nimport os\n"),
        (11, apache), (12, apache.split("APPENDIX")[0]), (13, "\n\n".join(body.split("\n\n")[:-1]) + "\n\nother end"), (14, "a\n\n" + body + "\n\nb\n\n" + body), (15, published("GPL-3.0")), (15, published("GPL-3.0")),
        (16, "Copyright 2019 X\n\n" + published("BSD-3-Clause").split("\n\n", 2)[2].replace("HOLDER", "OWNER")),
    ]
    out = licenses.scan(documents(spark, rows).withColumn("digest", F.lit("clash")).withColumn("row_no", F.lit("clash")), licenses.known_digests(spark)).collect()
    found = {(r.doc_id, r.unit, r.license) for r in out}
    assert found >= {(1, "text", "MIT"), (2, "text", "MIT"), (3, "passage", "MIT"), (4, "line", "CC-BY-NC-4.0"), (10, "passage", "Apache-2.0"), (11, "text", "Apache-2.0"), (12, "text", "Apache-2.0"), (14, "passage", "MIT"), (15, "text", "GPL-3.0"), (16, "text", "BSD-3-Clause")}
    assert not {r.doc_id for r in out} & {5, 6, 7, 8, 9, 13}
    assert {r.license for r in out if r.doc_id is None} == {"MIT"}
    assert sum(r.doc_id == 14 for r in out) == 1 and sum(r.doc_id == 15 and r.unit == "text" for r in out) == 2


def test_empty_scan(spark):
    assert licenses.scan(documents(spark, []), licenses.known_digests(spark)).count() == 0
