"""The registered queries and the pipeline on the smallest tables."""

from __future__ import annotations

import re
import zlib
from collections import Counter

import corpus_pipeline
import numpy as np
import pytest
from __spark_entry__ import oracle_sql, queries
from pagemill.llm.oracle import ORACLE
from pagemill.llm.queries import QUERIES
from tests.check_oracle import compare, connect
from tests.llm.samples import LOWER
from tests.llm.test_corpus_operators import plain_components
from tests.llm.test_text_operators import library_ids, plain_spans, plain_statistics

SF_DIR = "/root/testdata/sf0.001"


def test_names():
    assert sorted(int(re.fullmatch(r"op(\d+)_\w+", name)[1]) for name in QUERIES) == list(range(1, 14))
    assert queries().keys() > QUERIES.keys() | {"pipeline"} and oracle_sql().keys() > ORACLE.keys()
    assert corpus_pipeline.ORACLE_SQL is None and len(corpus_pipeline.STAGES) == 5


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_matches_sql(spark, name):
    ok, detail = compare(spark, connect(SF_DIR), SF_DIR, name)
    assert ok, detail


def passes_the_rules(text: str) -> bool:
    words, chars, symbols, repeated_lines, repeated_words = plain_statistics(text)
    lines = [line for line in text.split("\n") if line.strip(" \t\n\x0b\f\r")]
    return not (
        words < 50 or 100 * repeated_words > 50 * words or symbols * 10 > words or chars < 3 * words
        or chars > 12 * words or repeated_lines * 2 > len(lines) or len(re.findall("[A-Z]", text)) * 2 > chars
    )


def windows(text: str) -> set[tuple]:
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text.translate(LOWER))
    return {tuple(words[i : i + 10]) for i in range(len(words) - 9)}


def redacted(text: str) -> str:
    out, at = "", 0
    for number, (start, _, end, _) in enumerate(plain_spans(text)[1]):
        if start > at or (start == 0 and number == 0):
            out += text[at:start] + "[secret]"
        at = max(at, end)
    return out + text[at:]


def test_pipeline_equals_brute_force(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet").select("doc_id", "text").collect()
    rows = [(r.doc_id, r.text) for r in docs if passes_the_rules(r.text)]
    groups = plain_components(rows)
    rows = [(n, text) for n, text in rows if groups[n][1] == n]
    known = set().union(*[windows(r.text) for r in spark.read.parquet(f"{SF_DIR}/benchmark.parquet").collect()])
    rows = [(n, text) for n, text in rows if not windows(text) & known]
    wanted = Counter()
    for number, text in rows:
        ids = [*library_ids(redacted(text)), 2]
        cuts = [0, *range((len(ids) - 1) % 1024 + 1, len(ids), 1024), len(ids)]
        for piece, (a, b) in enumerate(zip(cuts, cuts[1:])):
            wanted[number, piece, a, b - a, zlib.crc32(np.array(ids[a:b], dtype="<u4").tobytes())] += 1
    got = corpus_pipeline.run(spark, SF_DIR).collect()
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == wanted and wanted
    held = Counter()
    for r in got:
        held[r.sequence_id] += r.length
    assert max(held.values()) <= 1024


def test_stages_keep_the_columns_of_documents(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs.limit(0), SF_DIR).dtypes == docs.dtypes
        changed = stage(spark, docs, SF_DIR)
        assert changed.dtypes == docs.dtypes and 0 < changed.count() <= docs.count()


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet").select("doc_id", "lang")
    found = QUERIES["op4_language_id"](spark, SF_DIR).join(docs, "doc_id")
    held_out = found.where("held_out and lang_pred <> 'und'").collect()
    assert held_out and sum(r.lang == r.lang_pred for r in held_out) >= 0.97 * len(held_out)
