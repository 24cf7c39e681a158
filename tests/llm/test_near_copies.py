import random

import numpy as np
import pyarrow as pa

from siltstone.llm import common, near_copies, simhash
from tests.llm.helpers import documents, texts


def shingle_set(t):
    w = (t or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def corpus():
    """Groups of texts with a few words changed in the middle, at the end, or by new words."""
    rng, rows = random.Random(3), []
    for g in range(60):
        base = [f"w{rng.randrange(5000)}" for _ in range(rng.choice((4, 40, 150, 400)))]
        rows.append(base)
        for _ in range(rng.randrange(4)):
            new = list(base)
            for _ in range(rng.randrange(1, 2 + len(base) // 40)):
                new[rng.randrange(len(new))] = f"n{rng.randrange(5000)}"
            rows.append(new + base[: rng.randrange(3)])
    return [(i, " ".join(x).title() if i % 7 == 0 else "  ".join(x)) for i, x in enumerate(rows)]


def brute(rows, least=0.8):
    sets, up = [shingle_set(t) for _, t in rows], list(range(len(rows)))

    def root(x):
        return x if up[x] == x else root(up[x])

    for i in range(len(rows)):
        for j in range(i):
            if jaccard(sets[i], sets[j]) >= least:
                a, b = sorted((root(i), root(j)))
                up[b] = a
    return sorted(rows[i][0] for i in range(len(rows)) if root(i) == i)


def test_stage_links_exactly_the_pairs_of_the_threshold(spark):
    import corpus_pipeline

    rows = corpus()
    sets = {d: shingle_set(t) for d, t in rows}
    pairs = [(a, b, jaccard(sets[a], sets[b])) for a in sets for b in range(a) if jaccard(sets[a], sets[b]) > 0.5]
    prints = {d: simhash.fingerprint(t.encode()) for d, t in rows}
    assert any(j >= 0.8 and (prints[a] ^ prints[b]).bit_count() > 4 for a, b, j in pairs)
    assert any(j < 0.8 for _, _, j in pairs)
    out = corpus_pipeline.without_near_copies(spark, documents(spark, rows), None)
    assert sorted(r.doc_id for r in out.collect()) == brute(rows)


def test_hard_rows(spark):
    rows = [*enumerate(texts()), (50, "one two three"), (51, "ONE two  three"), (52, "one two"), (None, "same text here"), (None, "same text here")]
    out = near_copies.kept_ones(documents(spark, rows)).collect()
    ids = [r.doc_id for r in out]
    assert ids.count(None) == 2 and {0, 3, 4, 9, 50, 52} <= set(ids) and not {1, 2, 10, 51} & set(ids)
    assert near_copies.kept_ones(documents(spark, [])).count() == 0


def test_large_groups_are_taken_apart_exactly(spark):
    """With room for few shingles in a task, groups meet by key, in chunks and pairs of chunks, and link the same pairs."""
    rng, rows = random.Random(9), []
    for g in range(6):
        shared = [f"s{g}w{i}" for i in range(60)]  # texts that share two thirds, in clusters that are close
        for c in range(4):
            own = [f"s{g}c{c}w{i}" for i in range(25)]
            for _ in range(8):
                new = [*shared, *own]
                new[rng.randrange(len(new))] = f"n{rng.randrange(10**6)}"
                rows.append(new)
    rows = [(i, " ".join(x)) for i, x in enumerate(rows)] + [(1000 + i, t) for i, (_, t) in enumerate(corpus())]
    docs = documents(spark, rows)
    want = brute(rows)
    for held in (300,):
        gone = near_copies.classes(docs, held=held).where("doc_id <> component_id").select("doc_id").collect()
        assert sorted({d for d, _ in rows} - {r.doc_id for r in gone}) == want, held


def test_simhash_finds_what_no_band_does(spark):
    """Words added until the sets share no band; within the radius and at 0.8, they are candidates by SimHash alone."""
    rng = random.Random(4)
    for _ in range(40):
        a = [f"w{rng.randrange(10**6)}" for _ in range(300)]
        b, apart = list(a), 0
        while apart < near_copies.BANDS and len(b) < 370:
            tried = [[*b, f"n{rng.randrange(10**6)}"] for _ in range(40)]
            apart, b = max((int(np.sum(bands(a) != bands(x))), x) for x in tried)
        if apart == near_copies.BANDS and (prints(a) ^ prints(b)).bit_count() <= near_copies.RADIUS and jaccard(shingle_set(" ".join(a)), shingle_set(" ".join(b))) >= 0.8:
            break
    else:
        raise AssertionError("no such pair")
    rows = [(7, " ".join(a)), (3, " ".join(b)), (5, "another text of other words here")]
    for held in (near_copies.HELD_SHINGLES, 100):
        out = {r.doc_id: r.component_id for r in near_copies.classes(documents(spark, rows), held=held).collect()}
        assert out == {7: 3, 3: 3, 5: 5}, held


def bands(words):
    return near_copies.keys(near_copies.shingles(" ".join(words)))


def prints(words):
    return near_copies.fingerprint(near_copies.shingles(" ".join(words)))


def test_workers_forget_words_of_other_stages(spark):
    """After a near-copy task its worker holds none of the words that encoding left there."""
    import public_tokenizers

    file = public_tokenizers.path("byte_bpe_50k.json")

    def held(batches):
        from siltstone.llm.tokens import encoder

        for batch in batches:
            encoder(file).ids("some words to hold")
            yield batch

    def left(batches):
        from siltstone.llm.tokens import encoder

        for _ in common.trimmed(held)(batches):
            pass
        yield pa.RecordBatch.from_arrays([pa.array([len(encoder(file))], pa.int64())], names=["n"])

    assert [r.n for r in spark.range(0, 5, 1, 1).mapInArrow(left, "n long").collect()] == [0]
