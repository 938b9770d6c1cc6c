from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from quillwork.operators.filters import page, search_contains, subsample_even
from quillwork.operators.ordered import Ordered
from quillwork.plans.frames import SelectOptions, select_frames
from quillwork.plans.report import Session, analysed_sources, json_report, markdown_report, numbered_report, write_report
from quillwork.plans.research import consensus_prompt, research_session, text_parts


def _client(calls: str):
    """Answers that leave a file for every call."""

    def make():
        def answer(row: dict) -> tuple[str, int, int]:
            import os
            import uuid

            open(os.path.join(calls, uuid.uuid4().hex), "w").close()
            if row["system_prompt"] == "consensus":
                return json.dumps({
                    "executive_summary": "All agree",
                    "common_practices": [{"practice": "water", "confidence": 0.9, "supported_by": ["Source 1", "Source 2"]}],
                    "differences": [{"aspect": "time", "positions": [{"source": "Source 1", "position": "dawn"}]}],
                    "conflicting_advice": [{"topic": "salt", "conflict": "more or less", "sources": ["Source 2"]}],
                    "recommendation": {"summary": "Do it", "steps": ["first", "then"]},
                    "timeline": [{"step": 1, "label": "Start", "timing": "day 1", "detail": "dig"}],
                }), 10, 1
            if "bad" in row["user_prompt"]:
                raise ValueError("refused")
            return json.dumps({"summary": "s", "facts": [{"category": "c", "value": "v", "confidence": 1}], "entities": []}), 5, 1

        return answer

    return make


def _sources(spark, rows):
    df = spark.createDataFrame(rows, "session_id long, document_id long, title string, transcript string")
    return df.selectExpr("*", "'note' AS document_type", "'' AS subtitles", "'' AS screen", "'http://x/' || document_id AS url")


def test_one_call_for_each_part_and_consensus(spark, tmp_path):
    rows = [(1, 70, "A", "x"), (1, 20, "B", "y" * 50_000), (1, 30, "C", "bad"), (2, 5, "D", "z")]
    found = research_session(_sources(spark, rows), _client(str(tmp_path)), "gpt-4o", backoff=0.0, topic=F.lit("soil"))
    for part in (found.support, found.conflicts, found.facts, found.status, found.report, found.report_json):
        part.collect()
    ledger = found.ledger.collect()
    # a long source has three parts; a refused one is tried three times
    assert len(list(tmp_path.iterdir())) == 1 + 3 + 3 + 1 + 1
    assert sorted(r.stage for r in ledger) == ["ANALYZING"] * 6 + ["COMPARING"]
    assert {r.source_label for r in found.facts.filter("session_id = 1").collect()} == {"Source 1: B", "Source 3: A"}
    prompt = found.consensus.first().user_prompt
    assert "Summary: Part 1: s\nPart 2: s\nPart 3: s\n" in prompt and "--- Source 3: A ---\nSummary: s\n" in prompt
    assert found.consensus.filter("session_id = 2").count() == 0


def _text(lines, session: int) -> str:
    rows = lines.filter(F.col("session_id") == session).orderBy("section", "document_id", "pos").collect()
    return "\n".join(r.line for r in rows)


HEAD = {"mode": "topic", "input_value": "soil \"deep\"", "source_type": "web", "ai_provider": "p", "ai_model": "gpt-4o",
        "pipeline_version": "2.1", "generated_at": "2024-05-06T07:08:09+00:00"}
AGREED = {
    "executive_summary": "All agree",
    "common_practices": [{"practice": "water", "confidence": 0.9, "supported_by": ["Source 1", "Source 2"]}, "stray", {"practice": "p2"}],
    "differences": [{"aspect": "time", "positions": [{"source": "Source 1", "position": "dawn"}, 5]}, {"aspect": "none"}],
    "conflicting_advice": [{"topic": "salt", "conflict": "more or less", "sources": ["Source 2"]}],
    "recommendation": {"summary": "Do it", "steps": ["first", "then"], "rationale": "it works"},
    "timeline": [{"step": 1, "label": "Start", "timing": "day 1", "detail": "dig"}, {"step": 2, "label": "End"}],
}


def _report_client():
    def answer(row: dict) -> tuple[str, int, int]:
        if row["system_prompt"] == "consensus":
            return json.dumps(AGREED), 10, 1
        text = row["user_prompt"].split("Extracted text:\n", 1)[1].split("\n", 1)[-1]
        if "bad" in text:
            raise ValueError("refused")
        return json.dumps({
            "summary": f"about {text[:3]}", "recommendations": ["dig", "wait"], "warnings": ["hot", "wet"] if "w" in text else [],
            "mistakes": ["none"], "timeline": [{"step": 1, "label": "Own", "detail": "go"}],
            "facts": [{"category": "c", "value": text[:3], "confidence": 1, "evidence": "e"}],
            "entities": [{"name": "clay", "type": "soil", "confidence": 0.5}] if "w" in text else [],
        }), 5, 1

    return answer


ONE = """# Knowledge Research Report - soil "deep"

*Mode: topic | Sources: 1 | Model: gpt-4o | Pipeline: 2.1 | Generated: 2024-05-06T07:08:09+00:00*

## Executive Summary

about wxy

## Recommendation

1. dig
2. wait

## Timeline

1. **Own** - go

## Sources

### Source 1: W

http://x/9

about wxy

**Warnings:** hot; wet

## Extracted Facts

| Category | Subcategory | Value | Confidence | Source |
|---|---|---|---|---|
| c |  | wxy | 1.0 | Source 1: W |

## Entities

| Entity | Type | Category | Confidence |
|---|---|---|---|
| clay | soil |  | 0.5 |
"""

TWO = """# Knowledge Research Report - soil "deep"

*Mode: topic | Sources: 2 | Model: gpt-4o | Pipeline: 2.1 | Generated: 2024-05-06T07:08:09+00:00*

## Executive Summary

All agree

## Consensus

- **water** (confidence 0.9; Source 1, Source 2)
- **p2** (confidence 0; )

### Differences Between Sources

- **time**
  - Source 1: dawn
- **none**

## Conflicting Advice

- **salt**: more or less (Source 2)

## Recommendation

Do it

1. first
2. then

*Rationale: it works*

## Timeline

1. **Start** (day 1) - dig
2. **End** - 

## Sources

### Source 1: A

http://x/1

about abc

### Source 3: C

http://x/3

Part 1: about ccc
Part 3: about ddd

## Extracted Facts

| Category | Subcategory | Value | Confidence | Source |
|---|---|---|---|---|
| c |  | abc | 1.0 | Source 1: A |
| c |  | ccc | 1.0 | Source 3: C |
| c |  | ddd | 1.0 | Source 3: C |
"""


def test_whole_reports_of_one_and_two_sources(spark, tmp_path):
    long = "ccc" + "c" * 23_997 + "bad" + "d" * 23_997 + "end"
    rows = [(1, 9, "W", "wxy"), (2, 1, "A", "abc"), (2, 2, "B", "bad"), (2, 3, "C", long), (3, 4, "X", "bad")]
    sessions = spark.createDataFrame([(i, *HEAD.values()) for i in (1, 2, 3)], "session_id long, " + ", ".join(f"{c} string" for c in HEAD))
    found = research_session(_sources(spark, rows), _report_client, "gpt-4o", backoff=0.0, topic=F.lit("soil"), sessions=sessions)
    assert _text(found.report, 1) == ONE
    assert _text(found.report, 2) == TWO
    assert _text(found.report, 3) == ""

    fact = lambda value, source: {"category": "c", "subcategory": "", "value": value, "evidence": "e", "stage": "", "confidence": 1.0, "source_document": source}
    source = lambda index, ident, title, summary, warnings, times: {
        "index": index, "document_id": ident, "title": title, "url": f"http://x/{ident}", "summary": summary,
        "recommendations": ["dig", "wait"] * times, "warnings": warnings, "mistakes": ["none"] * times,
    }
    assert json.loads(_text(found.report_json, 1)) == {
        "session_id": 1, **HEAD, "executive_summary": "about wxy", "consensus": None,
        "recommendation": {"summary": "", "steps": ["dig", "wait"], "rationale": ""},
        "timeline": [{"step": 1, "label": "Own", "detail": "go"}], "conflicts": [],
        "documents": [source(1, 9, "W", "about wxy", ["hot", "wet"], 1)], "facts": [fact("wxy", "Source 1: W")],
        "entities": [{"entity_name": "clay", "entity_type": "soil", "category": "", "evidence": "", "confidence": 0.5, "source_document": "Source 1: W"}],
    }
    assert json.loads(_text(found.report_json, 2)) == {
        "session_id": 2, **HEAD, "executive_summary": "All agree", "consensus": AGREED, "recommendation": AGREED["recommendation"],
        "timeline": AGREED["timeline"], "conflicts": AGREED["conflicting_advice"],
        "documents": [source(1, 1, "A", "about abc", [], 1), source(3, 3, "C", "Part 1: about ccc\nPart 3: about ddd", [], 2)],
        "facts": [fact("abc", "Source 1: A"), fact("ccc", "Source 3: C"), fact("ddd", "Source 3: C")], "entities": [],
    }
    assert _text(found.report_json, 3) == ""

    write_report(found.report, str(tmp_path / "md"))
    parts = sorted((tmp_path / "md" / "session_id=2").glob("part-*"))
    assert "".join(p.read_text() for p in parts) == TWO + "\n"
    first = numbered_report(found.report).filter("session_id = 1 and at < 2").orderBy("at").collect()
    assert [r.line for r in first] == ONE.split("\n")[:2]


def test_a_consensus_of_several_parts(spark):
    content = [json.dumps({**AGREED, "executive_summary": f"s{i}", "timeline": []}) for i in range(2)]
    consensus = spark.createDataFrame([(1, i, c) for i, c in enumerate(content)], "session_id long, part long, content string")
    said = {"session_id": 1, "document_id": 1, "part": 0, "index": 1, "title": "t", "url": "", "source_label": "Source 1: t",
            "content": json.dumps({"summary": "own", "timeline": [{"step": 7, "label": "L"}]}), "status": "SUCCESS"}
    sources = analysed_sources(spark.createDataFrame([said], ", ".join(f"{k} {'long' if isinstance(v, int) else 'string'}" for k, v in said.items())))
    none = spark.createDataFrame([], "session_id long, document_id long, pos long, source_label string, category string, subcategory string, value string, confidence double, name string, type string")
    sessions = spark.createDataFrame([(1, *HEAD.values())], "session_id long, " + ", ".join(f"{c} string" for c in HEAD))
    session = Session(sessions, sources, none, none, consensus)
    got = json.loads(_text(json_report(session), 1))
    assert got["consensus"] == [json.loads(c) for c in content] and got["executive_summary"] == "s0"
    assert got["timeline"] == [{"step": 7, "label": "L"}] and got["facts"] == []
    text = _text(markdown_report(session), 1)
    assert "## Executive Summary\n\ns0\ns1\n" in text and text.count("- **water**") == 2 and "7. **L** - " in text


def test_json_report_reads_its_sources_twice(spark, tmp_path):
    columns = "session_id long, document_id long, index long, title string, url string, source_label string, summary string, "
    columns += ", ".join(f"{c} array<string>" for c in ("recommendations", "warnings", "mistakes", "timeline"))
    spark.createDataFrame([(1, 1, 1, "t", "", "S", "own", ["do"], [], [], [])], columns).write.parquet(str(tmp_path / "sources"))
    sources = spark.read.parquet(str(tmp_path / "sources"))
    none = spark.createDataFrame([], "session_id long, document_id long, pos long, source_label string, category string, subcategory string, value string, confidence double, name string, type string")
    sessions = spark.createDataFrame([(1, *HEAD.values())], "session_id long, " + ", ".join(f"{c} string" for c in HEAD))
    consensus = spark.createDataFrame([], "session_id long, part long, content string")
    lines = json_report(Session(sessions, sources, none, none, consensus))
    plan = lines._jdf.queryExecution().optimizedPlan().toString().split("\n")
    assert sum("Relation [" in line and "mistakes#" in line for line in plan) <= 2  # their place, and themselves
    assert json.loads(_text(lines, 1))["documents"][0]["summary"] == "own"


def test_nothing_is_cut_from_long_texts(spark):
    df = spark.createDataFrame([(1, "ab" * 25), (2, ""), (3, "x" * 20)], "id long, t string")
    rows = text_parts(df, "t", 20).orderBy("id", "part").collect()
    assert [len(r.t) for r in rows] == [20, 20, 10, 0, 20]
    facts = spark.createDataFrame([(1, d, p, "c", "v" * 30) for d in (1, 2) for p in range(40)], "session_id long, document_id long, pos long, category string, value string")
    heads = spark.createDataFrame([(1, d, f"Source {d}", "s") for d in (1, 2)], "session_id long, document_id long, source_label string, summary string")
    prompts = consensus_prompt(facts, heads, F.lit("t"), chars=500).orderBy("part").collect()
    assert len(prompts) == 2 and all(r.user_prompt.count("- [c]") == 40 for r in prompts)


def test_slow_changes_add_up_between_sampled_frames(spark):
    rows = [(0, i, i / 30, [0.2 * i] * 4, 1.0, 100.0, str(i)) for i in range(12)]
    df = spark.createDataFrame(rows, "k long, pos long, timestamp double, signature array<double>, pixel_std double, sharpness double, ocr_text string")
    options = SelectOptions(scene_threshold=0.35, sampling_fps=10.0, remove_duplicates=False, ignore_blank=False, ignore_blurred=False)
    picked = select_frames(Ordered.of(df, ["k"], "pos"), "scene_detection", options)
    assert sorted(r.pos for r in picked.collect()) == [0, 3, 6, 9]


def test_limits_and_wildcards(spark):
    df = spark.range(300).withColumn("t", F.when(F.col("id") == 7, "a\\b").otherwise("ab"))
    assert [r.id for r in search_contains(df, ["t"], "A\\B").collect()] == [7]
    for limit, offset in ((0, 0), (201, 0), (10, -1)):
        with pytest.raises(ValueError):
            page(df, [F.col("id")], "id", limit, offset)
    assert subsample_even(df.withColumn("k", F.lit(1)), ["k"], [F.col("id")]).count() == 300
