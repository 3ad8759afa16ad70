"""Pictures against plain restatements, pixel by pixel, and the guarded checkpoint."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sievewright.config import CHANNEL_MEAN, CHANNEL_STD, CurationError
from sievewright.functions import resample as R
from sievewright.operators import pictures as P
from sievewright.operators import scoring as S


def kernel(kind, x):
    if kind == "bilinear":
        return max(0.0, 1 - abs(x))
    sinc = lambda v: 1.0 if v == 0 else math.sin(math.pi * v) / (math.pi * v)
    return sinc(x) * sinc(x / 3) if abs(x) < 3 else 0.0


def plain_row(values, target, kind):
    """One line resized, pixel by pixel."""
    n, out = len(values), []
    for i in range(target):
        scale = n / target
        if kind == "area":
            w = [max(0.0, min((i + 1) * scale, j + 1) - max(i * scale, j)) for j in range(n)]
        else:
            w = [kernel(kind, (j + 0.5 - (i + 0.5) * scale) / max(scale, 1.0)) for j in range(n)]
        out.append(sum(a * b for a, b in zip(w, values)) / sum(w))
    return out


def plain(picture, height, width, kind, whole=False):
    level = (lambda v: min(255, max(0, math.floor(v + 0.5)))) if whole else (lambda v: v)
    lines = [[level(v) for v in plain_row(line, width, kind)] for line in picture]
    columns = [[level(v) for v in plain_row([line[x] for line in lines], height, kind)] for x in range(width)]
    return [[columns[x][y] for x in range(width)] for y in range(height)]


def grey(rng, height, width):
    return [[rng.randint(0, 255) for _ in range(width)] for _ in range(height)]


def frame(spark, pictures):
    rows = [(i, None if p is None else (len(p), len(p[0]), 1, [float(v) for line in p for v in line])) for i, p in enumerate(pictures)]
    return spark.createDataFrame(rows, f"k int, picture {P.PICTURE}").withColumn("at", F.lit("clash"))


@pytest.mark.parametrize("kind", ["area", "bilinear", "lanczos"])
def test_resizing_equals_pixel_by_pixel(spark, kind):
    rng = random.Random(kind)
    pictures = [grey(rng, h, w) for h, w in ((5, 7), (1, 1), (9, 4), (3, 20), (6, 6))]
    for h, w in ((3, 4), (6, 6), (11, 2)):
        for r in P.resized(frame(spark, pictures).repartition(3), h, w, kind).collect():
            got = np.array(r["resized"]["pixels"]).reshape(h, w)
            assert np.allclose(got, plain(pictures[r["k"]], h, w, kind), atol=1e-9) and r["at"] == "clash"


def test_hash_of_a_picture_of_another_size(spark):
    rng = random.Random(1)
    pictures = [grey(rng, 48, 80), grey(rng, 32, 32), grey(rng, 7, 200), None]
    got = {r["k"]: r["hash"] for r in P.picture_hashes(frame(spark, pictures)).collect()}
    assert got.pop(3) is None
    for k, h in got.items():
        square = plain(pictures[k], 32, 32, "lanczos", whole=True)
        low = []
        for u in range(8):
            for v in range(8):
                wave = lambda f, x: math.cos(math.pi * (2 * x + 1) * f / 64) * math.sqrt((1 if f == 0 else 2) / 32)
                low.append(sum(square[y][x] * wave(u, y) * wave(v, x) for y in range(32) for x in range(32)))
        low = low[1:]
        median = sorted(low)[31]
        assert h == sum((x > median) << (62 - i) for i, x in enumerate(low))


def test_a_hash_survives_enlarging(spark):
    rng = random.Random(8)
    coarse = grey(rng, 6, 6)
    big = [plain(coarse, n, n, "bilinear") for n in (64, 120)]
    a, b = (r["hash"] for r in P.picture_hashes(frame(spark, big), whole=False).orderBy("k").collect())
    assert (a ^ b).bit_count() <= 4


def test_preparation_is_centred_normalised_and_by_planes(spark):
    rng = np.random.default_rng(2)
    colour = rng.integers(0, 256, (6, 10, 3)).astype(float)
    rows = [(1, (6, 10, 3, colour.ravel().tolist())), (2, (2, 2, 1, [1.0, 2.0, 3.0, 4.0])), (3, (2, 2, 2, [0.0] * 8)), (4, (2, 2, 1, [1.0])), (5, None), (6, (0, 3, 1, []))]
    got = {r["k"]: r["planes"] for r in P.prepared(spark.createDataFrame(rows, f"k int, picture {P.PICTURE}"), 4).collect()}
    assert got[3] is got[4] is got[5] is got[6] is None and len(got[2]) == 3 * 4 * 4
    for c in range(3):
        wide = plain(colour[:, :, c].tolist(), 4, 6, "bilinear")
        want = [[(v / 255 - CHANNEL_MEAN[c]) / CHANNEL_STD[c] for v in line[1:5]] for line in wide]
        assert np.allclose(np.array(got[1]).reshape(3, 4, 4)[c], want)
    assert R.shorter_side(6, 10, 4) == (4, 6) and R.shorter_side(10, 6, 4) == (6, 4)
    assert R.centre(np.ones((1, 5, 1)), 3).sum() == 3


def test_augmentation_is_the_same_at_any_partitioning(spark):
    rng = random.Random(3)
    rows = frame(spark, [grey(rng, 20, 30) for _ in range(40)])
    read = lambda df: {r["k"]: (r["draws"], tuple(r["augmented"]["pixels"])) for r in df.collect()}
    one = read(P.augmented(rows.coalesce(1), 8, 42, key="k"))
    assert one == read(P.augmented(rows.repartition(7), 8, 42, key="k")) != read(P.augmented(rows, 8, 43, key="k"))
    draws = [d for d, _ in one.values()]
    assert {d["flip"] for d in draws} == {True, False} and all(abs(d["degrees"]) <= 10 for d in draws)
    for d in draws:
        assert 0 <= d["top"] <= 20 - d["height"] and 0 <= d["left"] <= 30 - d["width"] and 0.7 <= d["height"] * d["width"] / 600 <= 1


def test_augmented_pixels_pixel_by_pixel(spark):
    rng = random.Random(4)
    pictures = [grey(rng, 12, 16) for _ in range(6)]
    for r in P.augmented(frame(spark, pictures), 7, 1, key="k").collect():
        d = r["draws"]
        cut = [line[d["left"] : d["left"] + d["width"]] for line in pictures[r["k"]][d["top"] : d["top"] + d["height"]]]
        small = plain(cut, 7, 7, "bilinear")
        small = [line[::-1] for line in small] if d["flip"] else small
        c, s = math.cos(math.radians(d["degrees"])), math.sin(math.radians(d["degrees"]))
        for y in range(7):
            for x in range(7):
                u, v = x - 3, y - 3  # from the middle of the picture
                fx, fy = math.floor(c * u - s * v + 3.5), math.floor(s * u + c * v + 3.5)
                want = small[fy][fx] if 0 <= fx < 7 and 0 <= fy < 7 else 0.0
                assert r["augmented"]["pixels"][7 * y + x] == pytest.approx(want)


@pytest.fixture(scope="module")
def vectors(spark):
    rng = random.Random(5)
    rows = [(i, i % 3, [rng.gauss(3 * (i % 3 == j), 1) for j in range(4)]) for i in range(120)]
    return spark.createDataFrame([*rows, (200, None, [0.0] * 4), (201, 1, None), (202, 1, [1.0]), (203, 1, [1.0, None, 1.0, 1.0])], "k int, label int, v array<double>")


def test_scores_equal_products_row_by_row(spark, vectors, tmp_path):
    model = S.nearest_mean(vectors, "label", "v", 4)
    S.save_checkpoint(spark, model, f"{tmp_path}/model")
    with pytest.raises(Exception, match="EXISTS"):
        S.save_checkpoint(spark, model, f"{tmp_path}/model")
    back = S.load_checkpoint(spark, f"{tmp_path}/model")
    assert back.name == model.name and (back.weights == model.weights).all() and (back.bias == model.bias).all()
    rows = S.score(vectors.repartition(4), back, "v").collect()
    right = 0
    for r in rows:
        if r["k"] in (201, 202, 203):
            assert r["logits"] is None
            continue
        want = [sum(a * b for a, b in zip(w, r["v"])) + c for w, c in zip(model.weights.tolist(), model.bias.tolist())]
        assert r["logits"] == pytest.approx(want)
        right += r["label"] is not None and int(np.argmax(want)) == r["label"]
    assert right > 100 and S.score(vectors.limit(0), back, "v").count() == 0


@pytest.mark.parametrize(
    "reason,change",
    [
        ("there is none", None),
        ("it lacks digest", lambda t: t.drop("digest")),
        ("no row of facts", lambda t: t.where("kind <> 'facts'")),
        ("several rows of facts", lambda t: t.unionByName(t.where("kind = 'facts'"))),
        ("its format is 9", lambda t: t.withColumn("format", F.lit(9))),
        ("none or too many", lambda t: t.withColumn("inputs", F.lit(10**9))),
        ("not all there", lambda t: t.where("index is null or index <> 1")),
        ("has not 4 weights", lambda t: t.withColumn("weights", F.when(F.col("index") == 2, F.slice("weights", 1, 3)).otherwise(F.col("weights")))),
        ("not those that were saved", lambda t: t.withColumn("bias", F.col("bias") + 1)),
    ],
)
def test_damaged_checkpoints_are_refused_with_the_reason(spark, vectors, tmp_path, reason, change):
    if change:
        S.save_checkpoint(spark, S.nearest_mean(vectors, "label", "v", 4), f"{tmp_path}/whole")
        change(spark.read.parquet(f"{tmp_path}/whole")).write.parquet(f"{tmp_path}/model")
    with pytest.raises(CurationError, match=reason):
        S.load_checkpoint(spark, f"{tmp_path}/model")


def test_models_need_all_classes(spark, vectors):
    with pytest.raises(CurationError, match="labels"):
        S.nearest_mean(vectors.where("label <> 1"), "label", "v", 4)
