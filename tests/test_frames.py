"""The whole analysis of a job against a sequential restatement."""

from __future__ import annotations

import random

from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillwork.operators.ordered import Ordered
from quillwork.plans.frames import analyze_job

SCHEMA = (
    "job_id long, index long, timestamp double, signature array<double>, text_boxes long, uniformity double, saturation double, "
    "ocr_text string, ocr_confidence double, ocr_done boolean"
)
TEXTS = ["one\ntwo", "One\ntwo\nthree", "four five", "  ", "six\nseven"]


def _frames(seed: int):
    rng = random.Random(seed)
    rows = []
    for job in (1, 2):
        value = 0.0
        for i in range(60):
            value += rng.choice([0.0, 0.005, 0.05])
            done = rng.random() < 0.2
            rows.append((job, i, i / 2, [value] * 3, rng.randrange(80), rng.random(), rng.random() / 2,
                         "kept\ntext" if done else "", 0.9 if done else 0.0, done))
    return rows


def _text(job: int, index: int) -> str:
    return TEXTS[(job + index // 4) % len(TEXTS)]


def _read(df):
    at = (F.col("job_id") + F.floor(F.col("index") / 4)) % len(TEXTS)
    return df.withColumns({"ocr_text": F.element_at(F.array(*[F.lit(t) for t in TEXTS]), (at + 1).cast("int")), "ocr_confidence": F.lit(0.5)})


def test_a_job_from_features_to_questions(spark, sizes):
    rows = _frames(4)
    seq = Ordered.of(spark.createDataFrame(rows, SCHEMA), ["job_id"], "index")
    manual = [(1, "by hand", "manual"), (1, "old", "auto"), (3, "other job", "auto")]
    schema = analyze_job(seq, read=_read)[0].schema
    blank = dict.fromkeys(schema.names)
    known = [{**blank, "job_id": job, "text": text, "source": source} for job, text, source in manual]
    questions = spark.createDataFrame([tuple(r.values()) for r in known], T.StructType([T.StructField(f.name, f.dataType) for f in schema]))
    made, summary, scored = analyze_job(seq, questions, read=_read)
    want, texts = {}, {}
    for job in (1, 2):
        base, unique, asking, runs, before = None, 0, 0, 0, None
        for _, i, _, vector, boxes, uniform, saturation, text, _, done in (r for r in rows if r[0] == job):
            score = 0.35 * min(boxes / 60, 1) + 0.45 * min(max((uniform - 0.3) / 0.5, 0), 1) + 0.2 * (1 - min(saturation * 2.2, 1))
            same = base is not None and abs(vector[0] - base) <= 0.012
            if same:
                continue
            base, unique = vector[0], unique + 1
            if round(min(max(score, 0), 1), 4) < 0.55:
                continue
            asking += 1
            text = text if done else _text(job, i)
            texts[job, i] = text
            lines = {line.strip().lower() for line in text.split("\n") if line.strip()}
            if not lines:
                continue
            joins = before is not None and (len(lines & before) / len(lines | before) >= 0.35 or lines <= before or before <= lines)
            runs, before = runs + (not joins), lines
        want[job] = (60, unique, asking, runs)
    assert {r.job_id: (r.frames_total, r.frames_unique, r.frames_question, r.questions_created) for r in summary.collect()} == want
    found = made.collect()
    assert sorted(r.text for r in found if r.source == "manual") == ["by hand"]
    assert sum(r.source == "auto" for r in found) == sum(w[3] for w in want.values()) + 1
    got = {(r.job_id, r["index"]): r.ocr_text for r in scored.filter("is_question and not is_duplicate").collect()}
    assert got == texts and scored.count() == 120
