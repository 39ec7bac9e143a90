"""HTML extraction with a recurrent block labeller.

A page becomes the sequence of its leaf blocks. A numpy bidirectional LSTM reads, per block, a hashed tag-path vector
and a hashed-word vector, and labels every block with the whole page as context; the blocks of the article are joined.

The model is trained on `TRAINING_PAGES` generated pages (the documented bound) when it is first asked for, always to
the same weights; nothing of the input is sampled. The driver broadcasts the weights; each page is labelled on its own.

Defined results: null and empty pages, and pages without an article, give the empty text; rows are read one by one, so
repeated rows and ids give repeated results; an empty table gives an empty one; other columns are ignored. A page is read
in time and memory in proportion to its length, whatever it nests or leaves open.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import chunks
from tidemark.llm.block_labeller import Labeller
from tidemark.llm.html_blocks import blocks, vectors
from tidemark.llm.page_generator import Pages, example

TRAINING_PAGES = 1500


@lru_cache(maxsize=4)
def trained(pages: int = TRAINING_PAGES, seed: int = 11) -> Labeller:
    make = Pages(seed)
    examples = [example(make.page())[:2] for _ in range(pages)]
    model = Labeller()
    model.fit([e for e in examples if len(e[1])])
    return model


def main_texts(model: Labeller, pages: list[str | None]) -> list[str]:
    leaves = [blocks(p) for p in pages]
    flags = model.label([vectors(x) for x in leaves])
    return ["\n\n".join(b.text for b, keep in zip(x, f) if keep) for x, f in zip(leaves, flags)]


def extract(pages: DataFrame, model: Labeller | None = None) -> DataFrame:
    """page_id, url, text and n_chars of every row."""
    shared = pages.sparkSession.sparkContext.broadcast(model or trained())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for table in chunks.slices(pa.Table.from_batches([batch]), "html", 1 << 20):
                texts = main_texts(shared.value, table.column("html").to_pylist())
                columns = {"page_id": table.column("page_id"), "url": table.column("url"), "text": pa.array(texts, pa.string()), "n_chars": pa.array([len(t) for t in texts], pa.int64())}
                yield from pa.table(columns).to_batches()

    return pages.select("page_id", "url", "html").mapInArrow(run, "page_id long, url string, text string, n_chars long")


def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))
