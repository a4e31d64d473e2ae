import random

import duckdb

from shiftlab.llm import lines
from shiftlab.llm.queries import op7_line_dedup

FOLDER = "/root/testdata/sf0.01"


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j - 1] + (x != y), row[j] + 1, new[-1] + 1))
        row = new
    return row[-1]


def brute(rows):
    """Dropped lines by comparing every line with every earlier one."""
    own = [((i is None, i or 0, n), k, line.split()) for n, (i, t) in enumerate(rows) for k, line in enumerate((t or "").split("\n"))]
    own = sorted(x for x in own if x[2])
    out = []
    for at, (place, k, words) in enumerate(own):
        for other, j, earlier in own[:at]:
            near = min(len(words), len(earlier)) >= lines.NEAR_WORDS and distance(words, earlier) <= 1
            if earlier == words or near:
                first = next(o for o in own if o[2] == words)
                out.append((None if place[0] else place[1], k, None if other[0] else other[1], j, 0 if first[:2] == (other, j) else 1))
                break
    return sorted(out, key=repr)


def test_random_lines_equal_brute_force(spark):
    rng = random.Random(8)
    base = [" ".join(rng.choice("abcdefgh") * rng.randrange(1, 3) for _ in range(rng.randrange(6, 13))) for _ in range(14)]

    def vary(line):
        words = line.split()
        for _ in range(rng.choice([0, 0, 1, 1, 2])):
            at, what = rng.randrange(len(words)), rng.random()
            if what < 0.4:
                words[at] = "zz"
            elif what < 0.7:
                del words[at]
            else:
                words.insert(at, "yy")
        return " ".join(words)

    rows = [(i, "\n".join(vary(rng.choice(base)) for _ in range(rng.randrange(1, 5)))) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = lines.duplicate_lines(docs).drop("row").collect()
    wanted = brute(rows)
    assert sorted(map(tuple, found), key=repr) == wanted
    assert {w[4] for w in wanted} == {0, 1}


def test_edge_rows_and_empty_table(edge_docs, no_docs, spark, tmp_path):
    from tests.llm.conftest import EDGE_ROWS

    ordered = spark.createDataFrame(EDGE_ROWS, "doc_id long, text string").coalesce(1)
    found = lines.duplicate_lines(ordered).drop("row").collect()
    assert sorted(map(tuple, found), key=repr) == brute(EDGE_ROWS)
    assert lines.duplicate_lines(no_docs).count() == 0
    kept = lines.without_duplicate_lines(edge_docs)
    assert kept.columns == edge_docs.columns
    # Texts without a line stay, of the equal ones the first.
    assert sorted((r["doc_id"] for r in kept.collect()), key=repr) == sorted([1, 2, 3, 4, 5, 7, 8, 9, None, None], key=repr)
    assert lines.without_duplicate_lines(no_docs).count() == 0


def test_kept_lines_stay_in_order(spark, tmp_path):
    rows = [(1, "one\n\ntwo words\none"), (2, "two words\nnew\none\n\n"), (3, "one\ntwo words"), (4, None)]
    path = str(tmp_path / "docs")
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(path)
    kept = {r["doc_id"]: r["text"] for r in lines.without_duplicate_lines(spark.read.parquet(path)).collect()}
    assert kept == {1: "one\n\ntwo words", 2: "new\n\n", 4: None}


def test_query_equals_its_sql(spark):
    connection = duckdb.connect()
    connection.execute(f"CREATE VIEW documents AS SELECT * FROM '{FOLDER}/documents.parquet'")
    cursor = connection.execute(lines.ORACLE)
    columns, wanted = [d[0] for d in cursor.description], cursor.fetchall()
    result = op7_line_dedup(spark, FOLDER)
    assert result.columns == columns
    assert sorted(map(tuple, result.collect())) == sorted(wanted)


def test_variant_keys_meet():
    words = [f"w{i}" for i in range(30)]
    placed, plain, own = lines.variant_keys(words)
    for i in (0, 13, 29):
        shorter = words[:i] + words[i + 1 :]
        assert lines.variant_keys(shorter)[2] in plain
        assert lines.variant_keys([*words[:i], "other", *words[i + 1 :]])[0][i] == placed[i]
        assert set(lines.half_keys(words)) & set(lines.half_keys(shorter))
    assert own not in plain and len(set(placed)) == 30
