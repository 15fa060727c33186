"""op5: blocks meet by lots, whatever their number, and no copies of vectors are written for other cells."""

import os

import numpy as np
import pytest

from trajlake.llm import common, embedding_dedup


def data(n: int, d: int = 64, seed: int = 5):
    """Vectors in all directions, of which a fifth are near copies of others, in two labels."""
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, d))
    near = rng.choice(n, n // 5, replace=False)
    x[near] = x[rng.choice(n, n // 5)] + 0.03 * rng.normal(size=(len(near), d))
    return x, np.arange(n) % 2


@pytest.mark.parametrize("kind", ["float", "double"])
def test_lots_lose_and_add_no_link(spark, monkeypatch, kind):
    monkeypatch.setattr(embedding_dedup, "LOT_ROWS", (60, 90))
    monkeypatch.setattr(embedding_dedup, "MEETINGS", 7)
    x, label = data(900)
    frame = spark.createDataFrame([(k, v.tolist(), int(b)) for k, (v, b) in enumerate(zip(x, label, strict=True))], f"vec_id long, embedding array<{kind}>, label int")
    out = {r["id"]: r for r in embedding_dedup.near_duplicate_vectors(frame, cell_rows=40, block_rows=15).collect()}
    unit = embedding_dedup.unit(x.astype(np.float32 if kind == "float" else float).astype(float))
    links = (unit @ unit.T >= embedding_dedup.COSINE) & (label[:, None] == label)
    np.fill_diagonal(links, False)
    assert links.sum() > 100
    assert [out[k]["n_links"] for k in range(len(x))] == links.sum(axis=1).tolist()
    component = np.arange(len(x))
    while True:
        lower = np.minimum(component, np.where(links, component, len(x)).min(axis=1))
        if (lower == component).all():
            break
        component = lower
    assert [out[k]["component_id"] for k in range(len(x))] == component.tolist()


def test_written_tables_are_of_the_inputs_size(spark, monkeypatch):
    """In random directions nearly all vectors are guests of nearly all cells."""
    sizes, plain = [], embedding_dedup.materialize

    def sized(df, *args, **kwargs):
        out = plain(df, *args, **kwargs)
        path = common._paths[id(out)][1].removeprefix("file:")
        sizes.append(sum(os.path.getsize(os.path.join(path, f)) for f in os.listdir(path) if f.endswith(".parquet")))
        return out

    monkeypatch.setattr(embedding_dedup, "materialize", sized)
    x, label = data(4000)
    frame = spark.createDataFrame([(k, v.tolist(), int(b)) for k, (v, b) in enumerate(zip(x, label, strict=True))], "vec_id long, embedding array<double>, label int")
    assert embedding_dedup.near_duplicate_vectors(frame, cell_rows=50, block_rows=50).count() == 4000
    assert max(sizes) < 2 * x.nbytes, sizes
