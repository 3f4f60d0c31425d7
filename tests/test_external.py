"""Embedders in child processes: no row is lost whether a child dies, hangs or answers short."""

import inspect
import sys
import textwrap
from pathlib import Path

import numpy as np
import pandas as pd
import pytest

from concord.operators import embed
from concord.operators.external import Partial, ProcessEmbedder

ROOT = str(Path(__file__).resolve().parents[1])
CHILD = """
import sys, time
import numpy as np
sys.path.insert(0, {root!r})
from concord.operators.external import serve

def embed(rows):
    names = list(rows["cell_id"])
    if "die" in names:
        print("x" * 5000 + " fell over", file=sys.stderr)
        sys.stderr.flush()
        sys.exit(3)
    if "hang" in names:
        time.sleep(600)
    out = np.array([[len(n), i] for n, i in zip(names, rows["x"])], float)
    return out[:-1] if "short" in names else out

serve(embed)
"""


@pytest.fixture
def command(tmp_path):
    script = tmp_path / "child.py"
    script.write_text(textwrap.dedent(CHILD).format(root=ROOT))
    return [sys.executable, str(script)]


def rows(names):
    return pd.DataFrame({"cell_id": names, "x": np.arange(len(names), dtype=float), "vec": [None] * len(names)})


def bisected(command, names, deadline=30.0, size=4):
    model = ProcessEmbedder(command, ["cell_id", "x"], deadline)
    try:
        return embed.bisected(model, rows(names), size)
    finally:
        if model.child:
            model.child.end()


def test_one_child_answers_all(command):
    vectors, errors = bisected(command, [f"c{i}" for i in range(23)])
    assert vectors == [[2.0 + (i > 9), float(i)] for i in range(23)] and errors == [None] * 23


@pytest.mark.parametrize(("bad", "said"), [("die", "fell over"), ("hang", "deadline")])
def test_only_the_row_itself_fails(command, bad, said):
    names = [f"c{i}" for i in range(10)]
    names[6] = bad
    vectors, errors = bisected(command, names, deadline=30.0 if bad == "die" else 4.0)
    assert [i for i, v in enumerate(vectors) if v is None] == [6] and said in errors[6] and len(errors[6]) <= 2000
    assert all(vectors[i] == [2.0, float(i)] for i in range(10) if i != 6)


def test_short_answers_go_on_from_the_first_unanswered_row(command):
    vectors, errors = bisected(command, ["a", "short", "b", "c", "d"], size=3)
    assert vectors[:1] + vectors[2:] == [[1.0, 0.0], [1.0, 2.0], [1.0, 3.0], [1.0, 4.0]]
    assert vectors[1] is None or vectors[1] == [5.0, 1.0]


def test_what_was_answered_is_kept(command):
    model = ProcessEmbedder(command, ["cell_id", "x"], 30.0)
    with pytest.raises(Partial) as e:
        model.embed(rows(["a", "b", "c", "d", "die"]), 2)
    assert [v[1] for v in e.value.done] == [0.0, 1.0, 2.0, 3.0] and model.child is None


def test_a_command_that_is_not_there():
    vectors, errors = bisected(["/no/such/program"], ["a", "b"])
    assert vectors == [None, None] and all("/no/such/program" in e for e in errors)


def test_in_tasks(spark, command):
    cells = spark.createDataFrame([("DRUG", f"c{i}" if i != 17 else "die", float(i)) for i in range(40)], "dataset_side string, cell_id string, x double").repartition(3)
    done = {r["cell_id"]: r for r in embed.embedded(cells, lambda: ProcessEmbedder(command, ["cell_id", "x"], 60.0), batch_size=8).collect()}
    assert len(done) == 40 and {c for c, r in done.items() if r["vec"] is None} == {"die"} and done["c5"]["vec"] == [2.0, 5.0]


def test_accepted():
    def old(a, *, b):
        return inspect

    assert embed.accepted(old, {"a": 1, "b": 2, "c": 3}) == {"a": 1, "b": 2}
    assert embed.accepted(lambda **kw: kw, {"c": 3}) == {"c": 3} and embed.accepted(lambda: 0, {"c": 3}) == {}
