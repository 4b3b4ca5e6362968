import numpy as np
import pytest
from quillon.llm.embedding_dedup import embedding_dedup, multi_sequence, region_gaps, stop_radius, train_codes


def brute(rows, threshold=0.98):
    ok = [v is not None and label is not None and all(x is not None and np.isfinite(x) for x in v) and any(v) for _, v, label in rows]
    n = len(rows)
    near = np.zeros((n, n), bool)
    for i in range(n):
        for j in range(n):
            if i != j and ok[i] and ok[j] and rows[i][2] == rows[j][2] and len(rows[i][1]) == len(rows[j][1]):
                a, b = np.array(rows[i][1], float), np.array(rows[j][1], float)
                near[i, j] = a @ b / (np.linalg.norm(a) * np.linalg.norm(b)) >= threshold
    low = [r[0] for r in rows]
    while True:
        new = [min([low[i], *(low[j] for j in np.flatnonzero(near[i]))]) for i in range(n)]
        if new == low:
            break
        low = new
    return sorted((rows[i][0], int(near[i].sum()), low[i], rows[i][0] == low[i]) for i in range(n))


def test_hard_cases(spark):
    rng = np.random.default_rng(1)
    rows, k = [], 0
    for label in (0, 1, 2):
        for _ in range(60):
            c = rng.normal(size=16) * rng.uniform(0.1, 9)
            for _ in range(rng.integers(1, 4)):
                rows.append((k := k + 1, [float(x) for x in c + rng.normal(size=16) * rng.uniform(0, 0.12) * np.abs(c).mean()], label))
    c = rng.normal(size=16)
    rows += [(k := k + 1, [float(x) for x in c + rng.normal(size=16) * 0.08], 7) for _ in range(120)]
    rows += [(k := k + 1, [float(x) for x in c], 7) for _ in range(40)]
    rows += [(5000, None, 1), (5001, [0.0] * 16, 1), (5002, [float("nan")] + [1.0] * 15, 1), (5003, [float("inf")] * 16, 1), (5004, [None] + [1.0] * 15, 1),
             (5005, rows[0][1], None), (5006, [1.0, 2.0], 1), (5007, [2.0, 4.0], 1), (5008, [1.0], 1), (5009, [-0.0, 1.0], 1), (5010, [0.0, 1.0], 1), (3, rows[2][1], rows[2][2])]
    df = spark.createDataFrame([(i, v, lab, 1) for i, v, lab in rows], "vec_id long, embedding array<double>, label int, n int").repartition(3)
    for block in (16, 512):
        assert sorted(map(tuple, embedding_dedup(df, block=block).collect())) == brute(rows)


def test_embeddings(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    rows = [(r.vec_id, list(r.embedding), r.label) for r in df.collect()]
    assert sorted(map(tuple, embedding_dedup(df).collect())) == brute(rows)


def test_empty(spark):
    assert embedding_dedup(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0


def test_gaps_are_lower_bounds():
    rng = np.random.default_rng(2)
    points, others = rng.normal(size=(300, 6)), rng.normal(size=(500, 6))
    centre = train_codes(others, 8)
    _, gap = region_gaps(points, centre)
    cell, _ = region_gaps(others, centre)
    far = np.sqrt(((points[:, None] - others[None]) ** 2).sum(-1))
    for k in range(len(centre)):
        if (cell == k).any():
            assert (far[:, cell == k].min(axis=1) >= gap[:, k] - 1e-9).all()


def test_multi_sequence_order():
    """The cells of each row are those up to the limit, in rising order of their cost."""
    rng = np.random.default_rng(3)
    a, b = rng.integers(0, 9, (50, 7)).astype(float), rng.integers(0, 9, (50, 11)).astype(float)
    for limit in (-1.0, 0.0, 6.0, 99.0):
        row, i, j = multi_sequence(a, b, limit)
        for v in range(50):
            cells = list(zip(i[row == v].tolist(), j[row == v].tolist()))
            cost = [a[v, x] + b[v, y] for x, y in cells]
            assert cost == sorted(cost)
            assert sorted(cells) == [(x, y) for x in range(7) for y in range(11) if a[v, x] + b[v, y] <= limit]


def cells_per_vector(points, codes, target):
    centre = [train_codes(points[:, :32], codes), train_codes(points[:, 32:], codes)]
    stop = stop_radius(points, *centre, 0.98, target)
    gaps = [region_gaps(points[:, :32], centre[0])[1] ** 2, region_gaps(points[:, 32:], centre[1])[1] ** 2]
    return len(multi_sequence(*gaps, stop * stop)[0]) / len(points) / codes**2


def test_more_codes_and_a_lower_target_visit_a_smaller_share():
    points = np.random.default_rng(5).normal(size=(600, 64))
    points /= np.linalg.norm(points, axis=1)[:, None]
    shares = [cells_per_vector(points, codes, 1.0) for codes in (8, 16, 32)]
    assert shares[0] > shares[1] > shares[2]
    assert cells_per_vector(points, 16, 0.95) < shares[1] / 2


def test_many_lengths(spark):
    """Vectors of every length take part, however many lengths there are."""
    rng = np.random.default_rng(6)
    rows = []
    for k in range(1, 60):
        v = rng.normal(size=k)
        rows += [(3 * k, [float(x) for x in v], 1), (3 * k + 1, [float(x) for x in v * 2], 1), (3 * k + 2, [float(x) for x in rng.normal(size=k)], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    assert sorted(map(tuple, embedding_dedup(df, sample=20).collect())) == brute(rows)


@pytest.mark.parametrize("target", [1.0, 0.9])
def test_recall(spark, target):
    rng = np.random.default_rng(4)
    base = rng.normal(size=(150, 64))
    rows = [(2 * k + s, [float(x) for x in v + s * rng.normal(size=64) * 0.1], 1) for k, v in enumerate(base) for s in (0, 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    rows = [(r.vec_id, list(r.embedding), r.label) for r in df.collect()]
    got, want = (sum(r[1] for r in x) for x in (embedding_dedup(df, target=target).collect(), brute(rows)))
    assert want > 100 and got >= target * want and (target < 1 or got == want)
