import random

import numpy as np
import pytest

from shiftlab.llm import decontam

ITEM = "What is the tallest mountain of the northern islands, and in which year was it first climbed by a team of three?"


def plain_edits(pattern, text):
    """Least edits of the pattern against any part of the text."""
    row = [0] * (len(text) + 1)
    for i, x in enumerate(pattern, 1):
        new = [i]
        for j, y in enumerate(text, 1):
            new.append(min(row[j - 1] + (x != y), row[j] + 1, new[-1] + 1))
        row = new
    return min(row)


def test_alignment_equals_plain_dynamic_programming():
    rng = random.Random(1)
    for _ in range(300):
        pattern, text = ([rng.randrange(3) for _ in range(rng.randrange(low, 12))] for low in (1, 0))
        edits, end = decontam.align(np.array(pattern, np.uint32), np.array(text, np.uint32), -20, 20)
        assert edits == plain_edits(pattern, text) and 0 <= end <= len(text)


def edit(text, n, rng):
    out = list(text)
    for _ in range(n):
        at, what = rng.randrange(len(out)), rng.random()
        if what < 0.4:
            out[at] = rng.choice("qxz")
        elif what < 0.7:
            del out[at]
        else:
            out.insert(at, rng.choice("qxz"))
    return "".join(out)


def test_every_match_within_the_budget_is_found():
    rng, table = random.Random(2), decontam.fold_table()
    index = decontam.build_index([(1, ITEM)])
    k, pattern = int(index.budget[0]), index.segments[0]
    texts = ["lorem ipsum dolor " * rng.randrange(0, 5) + edit(ITEM, rng.randrange(0, k + 4), rng).upper() + " sit amet" * rng.randrange(0, 4) for _ in range(80)]
    found = decontam.search(texts, index, table)
    seen = set()
    for text, hits in zip(texts, found):
        chars, _ = decontam.normalise(text, table)
        edits = plain_edits(pattern.tolist(), chars.tolist())
        assert bool(hits) == (edits <= k)
        assert not hits or hits[0][3] == edits
        seen.add(bool(hits))
    assert seen == {True, False}


def test_places_are_code_points_of_the_whole_text():
    index, table = decontam.build_index([("a", ITEM)]), decontam.fold_table()
    text = "😀 İé -- " + ITEM.replace(" ", "\n* ") + " 😀 " + ITEM
    hits = decontam.search([text], index, table)[0]
    assert [h[0] for h in hits] == ["a", "a"] and [h[3] for h in hits] == [0, 0]
    assert text[hits[0][1] : hits[0][2]].startswith("What") and text[hits[1][1] : hits[1][2]] == ITEM[:-1]


def test_half_of_a_long_item_is_found():
    rng = random.Random(4)
    item = " ".join("".join(rng.choice("abcdefghij") for _ in range(5)) for _ in range(90))
    index, table = decontam.build_index([(3, item)]), decontam.fold_table()
    assert decontam.search([f"x {item[150:420]} y"], index, table)[0]
    assert not decontam.search([f"x {item[150:260]} y"], index, table)[0]


def test_small_documents_equal_brute_force(small, small_rows):
    table = decontam.fold_table()
    plain = lambda t: "".join(map(chr, decontam.normalise(t, table)[0])).strip()
    items = {r["item_id"]: plain(r["text"]) for r in small("benchmark").collect()}
    found = decontam.contaminations(small("documents"), small("benchmark")).collect()
    wanted = {(i, k) for i, t in small_rows for k, item in items.items() if item in plain(t)}
    assert wanted and {(r["doc_id"], r["item_id"]) for r in found} == wanted
    texts = dict(small_rows)
    assert all(items[r["item_id"]][:20] in plain(texts[r["doc_id"]][r["start"] : r["end"]]) for r in found)


def test_blocks_change_nothing(small, spark, monkeypatch):
    benchmark = small("benchmark")
    whole = decontam.contaminations(small("documents"), benchmark).collect()
    parts = list(decontam.blocks(benchmark, "item_id", "text", 2_000))
    assert len(parts) > 2 and sum(map(len, parts)) == benchmark.count()
    monkeypatch.setattr(decontam.blocks, "__defaults__", (2_000,))
    split = decontam.contaminations(small("documents"), benchmark).collect()
    assert sorted(map(tuple, split)) == sorted(map(tuple, whole))


def test_edge_rows_and_empty_tables(spark, make_docs, edge_docs, no_docs):
    from tests.llm.conftest import EDGE_ROWS

    benchmark = spark.createDataFrame([(1, ITEM), (2, None), (3, ""), (4, "too short"), (None, "x" * 40), (5, EDGE_ROWS[4][1])], "item_id long, text string")
    found = decontam.contaminations(edge_docs, benchmark).collect()
    assert sorted((r["doc_id"], r["item_id"]) for r in found) == [(5, 5), (5, 5), (6, 5)]
    assert decontam.contaminations(no_docs, benchmark).count() == 0
    assert decontam.contaminations(edge_docs, benchmark.where("false")).count() == 0
    kept = decontam.drop_contaminated(edge_docs, benchmark)
    assert kept.columns == edge_docs.columns and kept.count() == len(EDGE_ROWS) - 3
    assert decontam.drop_contaminated(edge_docs, benchmark.where("false")).count() == len(EDGE_ROWS)
    exact = make_docs([(1, ITEM), (2, ITEM.lower() + " and more"), (3, "nothing here")])
    assert [r["doc_id"] for r in decontam.drop_contaminated(exact, benchmark).collect()] == [3]


@pytest.mark.parametrize("text", ["", "ab", "é" * 5])
def test_texts_shorter_than_a_gram(text):
    assert decontam.search([text], decontam.build_index([(1, ITEM)]), decontam.fold_table()) == [[]]


def test_short_items_are_found_as_whole_words(spark, make_docs):
    rows = [(1, "So: who wrote -- Hamlet, in 1601, then?"), (2, "who wrote hamlet in 16011"), (3, "eyes yes YES"), (4, None), (5, "xa b"), (6, "a\nB a b c")]
    docs = make_docs(rows)
    items = spark.createDataFrame([(1, "Who wrote Hamlet in 1601?"), (2, "yes"), (3, "..."), (4, "a b"), (5, None), (6, "")], "item_id long, text string")
    found = sorted(tuple(r) for r in decontam.contaminations(docs, items).collect())
    assert found == [(1, 1, 4, 32, 0), (3, 2, 5, 8, 0), (3, 2, 9, 12, 0), (6, 4, 0, 3, 0), (6, 4, 4, 7, 0)]
    assert sorted(r["doc_id"] for r in decontam.drop_contaminated(docs, items).collect()) == [2, 4, 5]
