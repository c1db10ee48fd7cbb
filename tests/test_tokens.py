import json

import pytest
from pyspark.sql import functions as F

from kinetrail.functions import tokens as T
from kinetrail.operators import stats as S
from kinetrail.sources import readers as R

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"


def test_round_trip(spark):
    texts = ["Hello world", "", None, "naïve 東京 <|endoftext|> 12345", "a" * 5000]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string")
    out = T.decode(T.encode(df, "text", VOCABULARY), "ids", VOCABULARY, "back")
    assert [r.back for r in out.orderBy("i").collect()] == texts


def test_special_tokens():
    ids, roles = T.with_special(["<a>", "<b>", "<a>"], 100, {"start": "<a>", "end": "<b>"})
    assert ids == {"<a>": 100, "<b>": 101} and roles == {"start": 100, "end": 101}


def test_small_is_checked(spark):
    df = spark.range(10)
    plan = lambda d: spark.range(5).join(d, "id")._jdf.queryExecution().optimizedPlan().toString()
    assert "strategy=broadcast" in plan(S.small(df, 10)) and "strategy=broadcast" not in plan(S.small(df, 9))
    with pytest.raises(ValueError):
        S.draw_by_weight(df, "id", "id", S.MAX_DRAWS + 1, lambda i: i)


def test_lists_and_clients(spark, tmp_path):
    path = tmp_path / "l.json"
    path.write_text(json.dumps([{"id": "2", "label": "b"}, {"id": "1", "label": "a"}]))
    labels = R.json_list(spark, str(path), "id string, label string")
    assert [r.video for r in R.labelled_videos(labels, "/v/").collect()] == ["/v/1.webm", "/v/2.webm"]
    assert R.labelled_videos(labels, "/v", seed=3, n=1).count() == 1
    said = R.annotated(labels, lambda b: b.assign(answer=b["label"].str.upper())[["id", "answer"]], "id string, answer string")
    assert {r.answer for r in said.collect()} == {"A", "B"}
    assert spark.range(1).select(F.length(R.statistics_key("a", "b"))).first()[0] == 64


def test_known_special_tokens():
    ids, roles = T.with_special(["<a>", "<b>", "<c>"], 100, {"start": "<a>", "end": "<c>"}, known={"<b>": 7, "<a>": 9})
    assert ids == {"<c>": 100} and roles == {"start": 9, "end": 100}


def test_digitwise_split(spark):
    """Numbers digit by digit, line ends apart, letters composed first; ids lead back to the text."""
    df = spark.createDataFrame([("it'S 1234\n\n  x",), ("cafe\u0301",), (None,)], "text string")
    out = T.decode(T.encode(df, "text", VOCABULARY, pattern=T.DIGITWISE, composed=True), "ids", VOCABULARY, "back").collect()
    assert [r.back for r in out] == ["it'S 1234\n\n  x", "caf\u00e9", None]
    plain = T.encode(df, "text", VOCABULARY).collect()
    assert len(out[0].ids) >= len(plain[0].ids)
