"""Settings and formatting."""

import pytest
from pyspark.sql import functions as F

from loomline import config
from loomline.cli import build_parser, setting
from loomline.functions import text as T
from loomline.models import ExtractiveGenerator
from loomline.plans import retrieve


def test_coercions():
    assert config.positive_or_none("4") == 4 and config.positive_or_none("0") is None and config.positive_or_none("x") is None and config.positive_or_none(False) is None
    assert config.not_negative("-3") == 0 and config.not_negative("x", 7) == 7
    assert not config.yes("false") and config.yes("on") and config.yes("", True) and not config.yes(0)
    assert config.backend("MLX") == "mlx_lm" and config.backend("vision") == "mlx_vlm" and config.backend("tq-mlx") == "turboquant_mlx" and config.backend(None) == "mlx_lm"
    with pytest.raises(ValueError):
        config.backend("other")
    assert config.media_list(" a ") == ["a"] and config.media_list(["", "b"]) == ["b"] and config.media_list(None) is None
    options = config.generation_options({"kv_bits": "3", "turboquant_fast": "false", "prefill_step_size": "0"})
    assert options == {"fast": False, "kv_bits": 3, "kv_group_size": 64, "min_tokens": 0, "prefill_step_size": 2048}


def test_retrieval_settings():
    s = config.RetrievalSettings.of({"top_k": "20", "rerank_alpha": "0.5", "unknown": 1})
    assert (s.top_k, s.fetch_k, s.rerank_alpha) == (20, 60, 0.5)


def test_precedence():
    assert setting("flag", {"k": "config"}, "k", "default") == "flag" and setting("", {"k": "config"}, "k", "default") == "config" and setting("", {}, "k", "default") == "default"
    assert build_parser().parse_args(["chunk", "--size", "5"]).size == "5"


def test_labels(spark):
    df = spark.createDataFrame([("pdf::a.pdf#section=1-2:pages=3-4:block=0", {"title": "T"}, 0.5, None, 75.0)], "ref string, m map<string,string>, s double, f double, t double")
    out = df.select(
        T.source_line(F.lit("pdf"), F.col("ref"), F.lit(None).cast("string"), F.col("m"), F.col("s"), F.col("f")).alias("a"), T.score_explanation(F.col("s"), F.col("f"), F.lit(0.25), F.lit(None).cast("double")).alias("b"),
        T.answer_time(F.col("t")).alias("c"), T.page_label(F.col("ref"), F.col("m")).alias("d"),
    ).first()
    assert tuple(out) == ("- PDF: `T` | chapter: `unknown` | page: `3-4` (score=0.5000)", "final=0.5000, rerank=0.2500", "1m 15.0s", "3-4")


def test_rewrite_needs_a_history(spark):
    df = spark.createDataFrame([("a", "And then?", "USER: x"), ("b", " Plain ", " ")], "query string, question string, history string")
    out = {x.query: x.search for x in retrieve.rewrite_queries(df, ExtractiveGenerator()).collect()}
    assert out["b"] == "Plain" and out["a"] == "And then?" or out["a"].startswith("Question")
    assert {x.search for x in retrieve.rewrite_queries(df, ExtractiveGenerator(), enabled=False).collect()} == {"And then?", "Plain"}
