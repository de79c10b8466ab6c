import json
import math
import tracemalloc

import numpy as np
import pytest

from lodeworks.llm import ann, packing, tool_calls

SCHEMA = {"search": {"type": "object", "properties": {"query": {"type": "string"}}, "additionalProperties": False}}


def linked(spark, arguments):
    calls = spark.createDataFrame([(0, str(i), i, "search", a, None) for i, a in enumerate(arguments)], "conv_id long, call_id string, turn long, name string, arguments string, needs array<string>")
    results = spark.createDataFrame([(0, str(i), i + 1, "fine") for i in range(len(arguments))], "conv_id long, call_id string, turn long, content string")
    return {int(r.call_id): r for r in tool_calls.link(calls, results, SCHEMA).collect()}


def test_odd_json(spark):
    nested = ["[" * d + "]" * d for d in (990, 996, 997, 998, 999, 1000, 5000)]
    odd = ['{"query":"\\ud800"}', '{"\\udfff x":1}', '{"query":"\\ud83d\\ude42"}', "", " ", "null", "NaN", '{"query":""}', '{"query":', '"' + "long " * 100_000 + '"', "9" * 5000, '{"a":1,"a":2}', None]
    found = linked(spark, odd + nested)
    assert len(found) == len(odd) + len(nested)
    for i, r in found.items():
        json.loads(r.message) if i < len(odd) else None
        assert r.message.startswith('{"call":{"arguments":') and r.message.endswith(f',"name":"search"}},"id":"{i}","result":"fine"}}')
    assert found[0].status == "ok" and '"query":"\\ud800"' in found[0].message
    assert found[1].errors == ["$.\\udfff x: unknown"]
    assert found[2].status == "ok" and "\U0001f642" in found[2].message
    assert found[6].errors == found[8].errors == found[10].errors == ["no JSON"] and found[7].status == "ok"
    assert all(found[len(odd) + k].errors in (["$: not object"], ["no JSON"]) for k in range(len(nested)))


def plain_places(q, phases, totals, quantum):
    """Round by round: where the tokens of a queue go."""
    out = {}
    for phase, after in zip(phases, [*phases[1:], None]):
        sent, at = list(phase["sent"]), phase["at"]
        if after is None:
            for k, t in enumerate(totals):
                for x in range(sent[k] * quantum, t):
                    if k == q:
                        out[x] = at
                    at += 1
            break
        credit = [0] * len(totals)
        for _ in range(phase["rounds"]):
            for k, r in enumerate(phase["rate"]):
                before, credit[k] = credit[k] >> packing.POINT, credit[k] + r
                for x in range((sent[k] + before) * quantum, (sent[k] + (credit[k] >> packing.POINT)) * quantum):
                    if k == q:
                        out[x] = at
                    at += 1
    return out


@pytest.mark.parametrize("step", [1, 3, 2048])
@pytest.mark.parametrize("weights", [None, [5.0, 2.0, 1.0, 0.01]])
def test_places_against_rounds(monkeypatch, step, weights):
    monkeypatch.setattr(packing, "ROUNDS", step)
    totals, quantum = [9001, 20011, 4000, 130], 8
    phases = packing.rounds(totals, weights, 256, quantum)
    for q, total in enumerate(totals):
        plain = plain_places(q, phases, totals, quantum)
        for lo, hi in ((0, total), (17, total // 2), (total - 9, total)):
            got = [(x + i, at + i) for x, at, n in packing.places(q, lo, hi, phases, totals, quantum) for i in range(n)]
            assert got == [(x, plain[x]) for x in range(lo, hi)]


def test_a_small_source_beside_large_ones():
    totals = [10**10] * 20 + [100_000]
    phases = packing.rounds(totals, None, 2048, 8)
    tracemalloc.start()
    runs = list(packing.places(20, 1000, 21_000, phases, totals, 8))
    assert tracemalloc.get_traced_memory()[1] < 20e6
    tracemalloc.stop()
    assert sum(n for *_, n in runs) == 20_000 and len(runs) <= 2501
    assert all(a[1] + a[2] <= b[1] for a, b in zip(runs, runs[1:]))


@pytest.mark.parametrize("scale", [1e200, 1e-200, 1e-320, 1.0])
def test_vectors_of_any_size(spark, scale):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(60, 8))
    scaled = x * scale
    rows = [(i, v) for i, v in enumerate(scaled.tolist())]
    found = ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), every=20, k=3).collect()
    assert len(found) == 9 and all(math.isfinite(r.score) for r in found)
    unit = scaled / np.abs(scaled).max(1, keepdims=True)
    unit /= np.sqrt((unit * unit).sum(1, keepdims=True))
    for r in found:
        assert abs(r.score - float(unit[r.query_id] @ unit[r.vec_id])) < 1e-9
