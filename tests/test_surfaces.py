"""Far collars through fields weigh as they do one by one."""

import numpy as np

from stratalake.operators import modelling as M
from stratalake.operators.surfaces import weighted_heights


def test_fields_equal_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(M, "PAIRS", 0)
    draw = np.random.default_rng(1)
    collars = np.concatenate([draw.uniform(0, 1000, (1500, 2)), draw.normal(500, 1, (200, 2))])
    collars, z = np.concatenate([collars, collars[:3]]), draw.uniform(-900, 9900, len(collars) + 3)
    cells = np.concatenate([draw.uniform(0, 1000, (150, 2)), collars[:20], draw.normal(500, 2, (30, 2)), [[9000.0, -40.0]]])
    asked = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(cells)] + [(900, None, 1.0)], "id long, x double, y double")
    held = spark.createDataFrame([(float(x), float(y), float(v)) for (x, y), v in zip(collars, z)] + [(None, 1.0, 1.0)], "x double, y double, z double")
    square = ((cells[:, None] - collars) ** 2).sum(2)
    hit = square == 0
    w = np.where(hit, 0, 1 / np.where(hit, 1, square))
    truth = np.where(hit.any(1), (hit * z).sum(1) / np.maximum(hit.sum(1), 1), (w * z).sum(1) / w.sum(1))
    found = {r.id: r.z for r in M.collar_surface(asked, held).collect()}
    assert found.pop(900) is None and len(found) == len(cells)
    assert max(abs(found[i] - v) for i, v in enumerate(truth)) < 1e-8
    alone = weighted_heights(asked.where("id < 1"), held.where("x IS NOT NULL").limit(1), 2.0).collect()
    assert len(alone) == 1 and alone[0].id == 0
