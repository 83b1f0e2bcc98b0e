"""Token counts by heap-and-linked-list byte-pair merging."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame

from quillon.llm.shared import batch, id_and_text, pieces, tidy
from quillon.llm.textwork import utf8
from quillon.llm.tokens import merge_counter


def count_tokens(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 2048) -> DataFrame:
    """Rows (doc_id, n_bytes, n_tokens, over_limit), one per input row.

    vocabulary: path of a word-level BPE file, the same on every machine. limit: over_limit is n_tokens > limit.
    A null or empty text has 0 bytes and 0 tokens; null ids stay null; repeated rows are counted each; an empty
    table gives no rows; extra columns are ignored. One pass, no shuffle; a text of any length is one row's work.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64()), ("over_limit", pa.bool_())])

    def run(batches):
        count = merge_counter(vocabulary)
        for b in pieces(batches):
            texts = b.column(1).to_pylist()
            n = [count.text(t) for t in texts]
            yield batch(schema, [b.column(0), [len(utf8(t)) for t in texts], n, [x > limit for x in n]])

    return id_and_text(docs, id_col, text_col).mapInArrow(tidy(run, keeps_words=True), "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
