import hashlib
import string

import numpy as np
import xxhash
from pyspark.sql import functions as F

from shiftlab.llm import imatch


def wanted_edits(rows):
    """doc_id, characters and digest of the edited text, in the documents' order."""
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), r[1] or ""))
    out = []
    for k, (i, t) in enumerate(order):
        t, following = t or "", order[(k + 1) % len(order)][1] or ""
        n = len(t) // 3
        out.append((i, len(t), hashlib.sha256((t[: len(t) - n] + following[:n]).encode()).hexdigest()))
    return sorted(out, key=repr)


def test_edited_documents(spark, small, small_rows):
    for parts in (1, 4, 7):
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        try:
            found = imatch.edited_documents(small("documents")).collect()
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", 4)
        assert sorted(((r["doc_id"], r["n_chars"], r["edited_sha256"]) for r in found), key=repr) == wanted_edits(small_rows)
    near, far = np.mean([r["near_edited"] for r in found]), np.mean([r["near_next"] for r in found])
    assert near > 0.05 and near > 5 * far
    texts = dict(small_rows)
    by_text = {}
    for r in found:
        assert 0 <= r["near_next"] <= 1 and 0 <= r["near_edited"] <= 1
        by_text.setdefault(texts[r["doc_id"]], set()).add(r["fingerprint"])
    assert all(len(v) == 1 for v in by_text.values()) and len({min(v) for v in by_text.values()}) == len(by_text)


def test_edge_rows_and_empty_table(edge_docs, no_docs):
    from tests.llm.conftest import EDGE_ROWS

    found = imatch.edited_documents(edge_docs).collect()
    assert sorted(((r["doc_id"], r["n_chars"], r["edited_sha256"]) for r in found), key=repr) == wanted_edits(EDGE_ROWS)
    assert imatch.edited_documents(no_docs).count() == 0


def test_a_document_alone_follows_itself(make_docs):
    row = imatch.edited_documents(make_docs([(5, "abcdefghi")])).first()
    assert row["edited_sha256"] == hashlib.sha256(b"abcdefabc").hexdigest() and row["near_next"] == 1


def plain_frequencies(rows):
    counts = {}
    for _, t in rows:
        for term in {w.strip(string.punctuation) for w in (t or "").lower().split()} - {""}:
            counts[term] = counts.get(term, 0) + 1
    return counts


def test_lexicon_holds_the_band(small, small_rows):
    docs, n = small("documents"), len(small_rows)
    wanted = {xxhash.xxh64_intdigest(t): k for t, k in plain_frequencies(small_rows).items()}
    assert {r["term"] % 2**64: r["n"] for r in imatch.frequencies(docs).collect()} == wanted
    inside = {t for t, k in wanted.items() if max(2, n**imatch.RAREST) <= k <= n**imatch.COMMONEST}
    above = {t for t, k in wanted.items() if k > n**imatch.COMMONEST}
    band, over, rest = imatch.lexicon(docs)
    assert set(band.tolist()) == inside and set(over.tolist()) == above and rest is None and above and inside
    for size in (0, 800, 8 * len(inside) // 2):
        band, over, rest = imatch.lexicon(docs, sent_bytes=size)
        rare = {r["term"] % 2**64 for r in rest.collect()}
        assert set(band.tolist()) | rare == inside and not set(band.tolist()) & rare
        assert 8 * (len(band) + len(over)) <= size
        assert max(wanted[t] for t in rare) < min((wanted[t] for t in (*band.tolist(), *over.tolist())), default=n + 1)


def test_rare_terms_stay_out_of_the_lexicon(make_docs):
    rows = [(1, "both have these rare1"), (2, "both have these rare2")] + [(i, f"other{i}") for i in range(3, 20)]
    prints = {r["doc_id"]: r["fingerprint"] for r in imatch.edited_documents(make_docs(rows)).collect()}
    # Each rare word is in one document only, so the two are alike in all the lexicon holds.
    assert prints[1] == prints[2] != prints[3]
    assert (imatch.lexicon(make_docs(rows))[0] == imatch.terms("both have these")).all()


def test_results_do_not_depend_on_what_is_sent(small, edge_docs, no_docs):
    for docs in (small("documents"), edge_docs, no_docs):
        wanted = sorted(map(tuple, imatch.edited_documents(docs).collect()), key=repr)
        for size in (0, 4000):
            assert sorted(map(tuple, imatch.edited_documents(docs, sent_bytes=size).collect()), key=repr) == wanted


def test_fingerprints_by_plain_sets(small, small_rows):
    n, counts = len(small_rows), plain_frequencies(small_rows)
    inside = {t for t, k in counts.items() if max(2, n**imatch.RAREST) <= k <= n**imatch.COMMONEST}
    found = {r["doc_id"]: bytes.fromhex(r["fingerprint"]) for r in imatch.edited_documents(small("documents")).collect()}
    for i, t in small_rows:
        words = {w.strip(string.punctuation) for w in (t or "").lower().split()} - {""}
        chosen = sorted(xxhash.xxh64_intdigest(w) for w in words & inside or words)
        if not chosen:
            continue
        slots = [slot(chosen, 0)]
        for level, (cells, used) in enumerate(imatch.LEVELS, 1):
            dealt = [[] for _ in range(cells)]
            for h in chosen:
                x = (h ^ level * 0x9E3779B97F4A7C15 % 2**64) * 0xBF58476D1CE4E5B9 % 2**64
                x = (x ^ x >> 31) * 0x94D049BB133111EB % 2**64
                dealt[x // (2**64 // cells)].append(x)
            slots += [slot(sorted(d), level) if d else bytes(imatch.SLOT_BYTES) for d in dealt[:used]]
        assert found[i] == b"".join(slots)


def slot(values, seed):
    data = b"".join(v.to_bytes(8, "little") for v in values)
    return (xxhash.xxh64_intdigest(data, seed) % (256**imatch.SLOT_BYTES - 1) + 1).to_bytes(imatch.SLOT_BYTES, "big")


def test_ranges_hold_equal_bytes(spark):
    rows = [(i, "x" * (5000 if i < 400 else 50)) for i in range(2000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for ids in (docs, docs.withColumn("doc_id", F.format_string("%05d", "doc_id"))):
        parts = imatch.in_order(ids, 10).where("not extra").groupBy("part").agg(F.sum(F.length("text"))).collect()
        assert 9 <= len(parts) <= 11 and max(r[1] for r in parts) < 2 * sum(r[1] for r in parts) / 10
        held = ids.select(imatch._below([r["doc_id"] for r in ids.orderBy("doc_id").limit(1999).collect()]).alias("n"))
        assert sorted(r["n"] for r in held.collect()) == list(range(2000))


def test_fingerprint_slots():
    none = np.zeros(0, np.uint64)
    everything = np.sort(np.concatenate([imatch.terms("the b c d e f"), imatch.terms(" ".join(f"w{i}" for i in range(300)))]))
    a = imatch.fingerprint("the b c d e f", everything)
    assert len(a) == imatch.SLOT_BYTES * (1 + imatch.SUBSETS)
    assert a == imatch.fingerprint("F e d, c b THE the", everything) == imatch.fingerprint("the b c d e f", none)
    assert imatch.fingerprint("", everything) != imatch.fingerprint("!", everything)
    words = [f"w{i}" for i in range(300)]
    b = imatch.fingerprint(" ".join(words), everything)
    c = imatch.fingerprint(" ".join(words[:-10]), everything)
    assert 0.4 < imatch.likeness(b, c) < 1 and imatch.likeness(a, b) < 0.1 and imatch.likeness(a, a) == 1


def test_parts_end_with_the_following_document(spark):
    docs = spark.createDataFrame([(i, str(i)) for i in range(50)] + [(None, "n")], "doc_id long, text string")
    rows = imatch.in_order(docs, 5).orderBy("part", "extra", F.col("doc_id").desc_nulls_last()).collect()
    parts = sorted({r["part"] for r in rows})
    for part, following in zip(parts, [*parts[1:], parts[0]]):
        first = next(r for r in rows if r["part"] == following and not r["extra"])
        assert [r["doc_id"] for r in rows if r["part"] == part and r["extra"]] == [first["doc_id"]]
