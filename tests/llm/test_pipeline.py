"""The pipeline's stages, each against a plain version on its own input."""

import corpus_pipeline
from shiftlab.llm import language, simhash
from shiftlab.llm.common import staged
from tests.llm.test_lines import brute
from tests.llm.test_packing import tokenizer
from tests.llm.test_simhash import plain_components, plain_fingerprint

FOLDER = "/root/testdata/sf0.001"


def ids(df):
    return sorted(r["doc_id"] for r in df.select("doc_id").collect())


def test_stages_one_after_the_other(spark, small):
    docs, seen = small("documents"), {}
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        seen[name] = docs
        docs = staged(stage(spark, docs, FOLDER), name)
        assert docs.columns == columns
    out = corpus_pipeline.STAGES[-1][1](spark, docs, FOLDER).collect()

    before = seen["language"]
    known = {r["doc_id"] for r in language.predict(before).collect() if r["lang_pred"] != "und" and r["score"] >= language.KEPT}
    assert ids(seen["line_dedup"]) == sorted(known) and len(known) > 190

    rows = sorted((r["doc_id"], r["text"]) for r in seen["line_dedup"].select("doc_id", "text").collect())
    gone = {(i, k) for i, k, *_ in brute(rows)}
    left = {i: "\n".join(x for k, x in enumerate(t.split("\n")) if (i, k) not in gone) for i, t in rows}
    wanted = {i: t for i, t in left.items() if t.strip() or t == dict(rows)[i]}
    assert {r["doc_id"]: r["text"] for r in seen["near_duplicates"].collect()} == wanted

    rows = sorted(wanted.items())
    roots = plain_components([plain_fingerprint(t) for _, t in rows])
    assert ids(seen["decontamination"]) == sorted({rows[r][0] for r in roots})

    tokens = {}
    for r in out:
        tokens[r["doc_id"]] = tokens.get(r["doc_id"], 0) + r["length"]
    encode = tokenizer().encode
    assert tokens == {r["doc_id"]: len(encode(r["text"], add_special_tokens=False).ids) + 1 for r in docs.collect()}
    assert 0 < len(tokens) < len(seen["decontamination"].collect())


def test_run_gives_the_rows_of_the_stages(spark):
    rows = corpus_pipeline.run(spark, FOLDER).collect()
    assert len({(r["sequence_id"], r["offset"]) for r in rows}) == len(rows) > 0
    assert corpus_pipeline.ORACLE_SQL is None


def test_stages_take_edge_rows_and_empty_tables(spark, edge_docs, no_docs):
    for docs in (edge_docs, no_docs):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            docs = staged(stage(spark, docs, FOLDER), "edge")
        packed = corpus_pipeline.STAGES[-1][1](spark, docs, FOLDER)
        assert (packed.count() > 0) == (docs.count() > 0)


def test_groups_without_ids_keep_one_row(make_docs):
    docs = make_docs([(None, "one two three four"), (None, "one two three four"), (3, "five six seven eight nine")])
    assert simhash.one_of_each(docs).count() == 2
