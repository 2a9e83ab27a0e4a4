"""Headline queries at ``$BENCH_SF_DIR`` on ``local[$BENCH_CPUS]``; prints one JSON line.

The token and text tables are built once from ``documents`` (B1) and stored as Parquet, as a corpus would be; the other
queries read the stored tables.
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

from pyspark.sql import functions as F

sys.path.insert(0, os.path.join(os.path.dirname(os.path.abspath(__file__)), "tests"))

from session import local_session  # noqa: E402

from wordloom.operators import hits as hit_ops, ordering, stats  # noqa: E402
from wordloom.operators.patterns import Gap, Tok, form_test, value_test, word  # noqa: E402
from wordloom.operators.selection import Choice, Selection, select_texts  # noqa: E402
from wordloom.plans import given  # noqa: E402
from wordloom.plans.corpus import Corpus  # noqa: E402
from wordloom.sources.tokens import save_blocks, save_tokens, vocabulary  # noqa: E402


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(int(os.environ.get("BENCH_CPUS", "8")), os.environ.get("BENCH_MEMORY", "16g"))
    store = tempfile.mkdtemp(prefix="wordloom-bench-")
    given.table(spark, folder, "region").count()
    seconds: dict[str, float] = {}

    def timed(name, run):
        begun = time.perf_counter()
        run()
        seconds[name] = round(time.perf_counter() - begun, 3)

    def consume(df):
        df.write.format("noop").mode("overwrite").save()

    def build():
        ranges = given.docs_ranges(spark, folder)
        ranges.write.parquet(f"{store}/texts")
        placed = given.docs_placed_tokens(spark, folder, spark.read.parquet(f"{store}/texts"), in_order=True, neighbours=True)
        save_tokens(placed, f"{store}/tokens", in_order=True)

    def build_blocks_and_vocabulary():
        kept = spark.read.parquet(f"{store}/tokens")
        save_blocks(kept, f"{store}/blocks")
        vocabulary(kept).write.parquet(f"{store}/words")

    timed("b1_tokenise_and_positions", build)
    timed("b1_blocks_and_vocabulary", build_blocks_and_vocabulary)
    whole = Corpus.opened(spark, store)
    # words of patterns are looked up in b11 and b12; the other queries run as on a corpus without a vocabulary
    corpus = Corpus(whole.tokens, whole.texts, blocks=whole.blocks)
    the_of_and = [word("the"), Gap(0, 2), word("of"), Gap(1, 3), word("and")]
    common = [Tok(value_test("lemma", ["the", "of", "de", "la", "der", "un", "is"]))]
    of_t = [word("of"), Tok(form_test("t", where="start"))]

    def shop_counts():
        selection = Selection({"status": Choice(("O",)), "part.brand": Choice(("Brand#3",), exclude=True)})
        chosen = select_texts(given.shop_texts(spark, folder), selection, given.shop_dimensions(spark, folder))
        stats.text_and_token_count(chosen).collect()

    def sorted_page():
        corpus.page(hit_ops.settled(corpus.search([of_t], sortable=True)), 100, "right").collect()

    def sample_in_context():
        drawn = ordering.sample_hits(corpus.search([[word("the")]]), 1000, seed=1)
        corpus.lines(drawn, longest=1, few=True).orderBy("text_id", "start").collect()

    timed("b2_one_word_count", lambda: hit_ops.count_hits(corpus.search([[word("the")]])).collect())
    timed("b3_three_terms", lambda: consume(corpus.search([[Tok(form_test("t", where="start")), word("the"), Tok(form_test("e", where="end"))]])))
    timed("b4_gaps", lambda: consume(corpus.search([the_of_and])))
    timed("b4_open_gap", lambda: consume(corpus.search([[word("that"), Gap(2), word("of"), Gap(0, 3), word("the")]])))
    timed(
        "b5_frequency_list",
        lambda: stats.by_frequency(
            stats.frequency_list(corpus.search([[Tok(form_test("th", where="start"))]], keep=("word",)))
        ).limit(1000).collect(),
    )
    timed(
        "b6_distribution",
        lambda: corpus.distribution(corpus.search([common], keep=("lemma",)), "lemma", "source").scores().collect(),
    )
    timed("b7_selection_counts", shop_counts)
    timed("b8_sorted_page_100", sorted_page)
    timed("b9_sample_in_context", sample_in_context)
    timed("b10_context_of_all_hits", lambda: consume(corpus.lines(corpus.search([[word("the")]]), longest=1)))
    few = Selection({"source": Choice(("src3",)), "lang": Choice(("en",))})
    timed("b11_search_in_selection", lambda: hit_ops.count_hits(corpus.search([[word("of"), word("the")]], few)).collect())
    timed("b12_regex_on_vocabulary", lambda: hit_ops.count_hits(whole.search([[Tok(value_test("word", ["[Tt]h.*ing", ".*eri.*ed"]))]])).collect())
    total = round(sum(seconds.values()), 3)
    print(json.dumps({"metric": "total_query_seconds", "value": total, "unit": "sec", "queries": seconds, "sf": folder}))


if __name__ == "__main__":
    main()
