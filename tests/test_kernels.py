import numpy as np
import pytest

from evidentia.functions import damage, kernels
from evidentia.operators import fragments, repair
from evidentia.streaming.progress import throttle_rows


def gradient(n):
    y, x = np.mgrid[:n, :n]
    return np.stack([2 * y, 2 * x, 255 - 2 * y], -1).clip(0, 255).astype(np.uint8)


def test_similarity_of_equal_pictures():
    g = gradient(64)
    assert kernels.psnr(g, g) == 100.0
    assert kernels.ssim(g, g) == pytest.approx(1.0)
    assert kernels.ssim(g, 255 - g) < 0.5


@pytest.mark.parametrize("fill", [lambda i, m: kernels.inpaint(i, m, 3), kernels.exemplar_fill, kernels.onion_fill])
def test_fills_change_only_the_mask_and_get_nearer(fill):
    g = gradient(32)
    mask = np.zeros((32, 32), bool)
    mask[10:18, 9:20] = True
    hurt = np.where(mask[..., None], 0, g).astype(np.uint8)
    out = fill(hurt, mask)
    assert np.array_equal(out[~mask], g[~mask])
    assert kernels.psnr(g, out) > kernels.psnr(g, hurt) + 5


def test_inpaint_is_exact_on_flat_pictures():
    flat = np.full((16, 16), 77, np.uint8)
    mask = np.zeros((16, 16), bool)
    mask[4:9, 4:9] = True
    assert np.array_equal(kernels.inpaint(np.where(mask, 0, flat).astype(np.uint8), mask), flat)


@pytest.mark.parametrize("f", [kernels.gaussian, kernels.median, kernels.box, kernels.bilateral, kernels.column_smooth])
def test_filters_keep_flat_pictures(f):
    flat = np.full((12, 12, 3), 90, np.uint8)
    assert np.array_equal(f(flat), flat)


def test_components():
    m = np.zeros((6, 6), bool)
    m[0, 0] = m[1, 1] = m[4, 4] = m[4, 5] = True
    label = kernels.components(m)
    assert label.max() == 2 and label[0, 0] == label[1, 1] != label[4, 4] == label[4, 5]


def test_morphology_and_edges():
    m = np.zeros((11, 11), bool)
    m[4:7, 4:7] = True
    assert kernels.dilate(m).sum() == 25 and kernels.erode(m).sum() == 1
    assert np.array_equal(kernels.opened(m, 3), m)
    g = np.zeros((16, 16), np.uint8)
    g[:, 8:] = 200
    assert kernels.edges(g).any() and not kernels.edges(np.full((16, 16), 9, np.uint8)).any()


def test_hashes_are_near_for_near_pictures():
    g = kernels.gray(gradient(64))
    up = np.clip(g.astype(int) + 5, 0, 255).astype(np.uint8)
    assert bin(kernels.difference_hash(g) ^ kernels.difference_hash(up)).count("1") <= 5
    assert bin(kernels.dct_hash(g) ^ kernels.dct_hash(up)).count("1") <= 5


@pytest.mark.parametrize("kind", sorted(damage.KINDS))
def test_damage_stays_in_its_mask_and_is_seeded(kind):
    g = gradient(32)
    one, mask = damage.KINDS[kind](g, np.random.default_rng(3))
    two, _ = damage.KINDS[kind](g, np.random.default_rng(3))
    near = kernels.dilate(mask, 21) if kind == "combined" else mask
    assert np.array_equal(one, two) and np.array_equal(one[~near], g[~near])


def test_combined_damage_has_unmarked_noise():
    g = np.full((40, 40), 120, np.uint8)
    out, mask = damage.combined(g, np.random.default_rng(1))
    assert not out[mask].any() and (out[~mask] != 120).any()


def test_vertical_bars_and_fills():
    g = gradient(32)
    out, mask = damage.bars(g, np.random.default_rng(1), count=3, thickness=2, vertical=True, fill="white")
    assert (mask == mask[0]).all() and 2 <= mask[0].sum() <= 6 and (out[mask] == 255).all()
    noisy, _ = damage.bars(g, np.random.default_rng(1), fill="noise")
    assert len(np.unique(noisy)) > 2


def test_imperfect_masks():
    mask = np.zeros((20, 20), bool)
    mask[8:12, 8:12] = True
    assert damage.imperfect(mask, np.random.default_rng(1), noise_ratio=0).sum() == 64
    assert np.array_equal(damage.imperfect(mask, np.random.default_rng(1), shrink=1, noise_ratio=0), mask)
    assert (damage.imperfect(mask, np.random.default_rng(1), widen=0, noise_ratio=0.05) != mask).any()


def test_png_decodes_by_the_image_source(spark, tmp_path):
    from evidentia.sources.tables import images

    g = gradient(16)
    (tmp_path / "a.png").write_bytes(kernels.png(g))
    row = images(spark, str(tmp_path)).first()
    got = np.frombuffer(row["data"], np.uint8).reshape(row["height"], row["width"], row["n_channels"])
    assert np.array_equal(got[..., ::-1], g)


def test_throttle():
    keep, _ = throttle_rows([0, 5, 29, 30, 59, 60], ["view"] * 6, None)
    assert keep == [True, False, False, True, False, True]
    keep, _ = throttle_rows([0, 5, 29], ["error"] * 3, None)
    assert keep == [True] * 3


def test_chain_follows_the_bytes(spark):
    data = bytes(range(256)) * 10
    rows = [(1, i, i * 640, bytearray(data[i * 640 : (i + 1) * 640])) for i in range(4)]
    out = fragments.greedy_chain(spark.createDataFrame(rows, "dump_id long, idx long, off long, data binary")).collect()
    assert sorted(r["idx"] for r in out) == [0, 1, 2, 3] and min(out, key=lambda r: r["place"])["idx"] == 0


def test_clusters_equal_brute_force(spark):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(3, 8))
    v = np.vstack([c + 0.05 * rng.normal(size=(6, 8)) for c in centres] + [rng.normal(size=(4, 8))])
    df = spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(v)], "vec_id long, embedding array<float>")
    got = {r["vec_id"]: r["cluster"] for r in fragments.clusters(df, 0.1).collect()}
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    near = 1 - u @ u.T <= 0.1
    label = np.arange(len(v))
    while True:
        new = np.array([label[near[i]].min() for i in range(len(v))])
        if (new == label).all():
            break
        label = new
    for i in range(len(v)):
        assert got[i] == (label[i] if near[i].sum() >= 2 else -1)


def test_best_candidate_has_the_top_score(spark):
    g = np.tile(np.arange(0, 64, 4, dtype=np.uint8), (16, 1))
    pics = spark.createDataFrame([("a", 16, 16, 1, bytearray(g.tobytes()))], repair.PICTURE)
    all_ = repair.repair(repair.corrupt(pics, ["rectangle_mask"])).select("strategy", "score", "image_id", "kind", "seq", "data").collect()
    top = repair.best(spark.createDataFrame(all_)).first()
    assert top["score"] == max(r["score"] for r in all_)


def test_pictures_of_one_mask_are_repaired_together(monkeypatch):
    """A stack's rows equal those of its pictures one by one; its mask is marched through once a radius."""
    rng, rows, calls, march = np.random.default_rng(3), [], [], kernels.marching
    mask = np.zeros((8, 8), bool)
    mask[2:5, 3:6] = True
    for i in range(40):
        img = rng.integers(0, 256, (8, 8)).astype(np.uint8)
        values = {"image_id": str(i), "kind": "k", "height": 8, "width": 8, "n_channels": 1, "original": img.tobytes(), "data": np.where(mask, 0, img).astype(np.uint8).tobytes(), "mask": mask.tobytes()}
        rows.append(type("Row", (), values))
    taken = {}
    monkeypatch.setattr(repair, "each", lambda pictures, f, schema: taken.update({schema[:42]: f}))
    monkeypatch.setattr(kernels, "marching", lambda m, r: calls.append(r) or march(m, r))
    kernels.kept_steps.cache_clear()
    repair.repair(None)
    repair.regional_repair(None)
    first, *_ = taken.values()
    together = list(first.stack(rows))
    assert sorted(calls) == [3, 5, 7]
    for f in taken.values():
        assert sorted(f.stack(rows)) == sorted(x for row in rows for x in f(row))
    assert len(together) >= 20 * len(rows) and [len(s) for s in repair.stacks(rows * 60)] == [1024, 1024, 352]


def test_chains_of_many_dumps_are_walked_together(monkeypatch):
    """Equal to a walk by continuity() pair by pair, which is left to pairs with a common window."""
    rng, slow = np.random.default_rng(5), []
    alphabet = [bytes(rng.integers(0, 256, 40, dtype=np.uint8)) for _ in range(3)]
    dumps = [[bytes(rng.integers(0, 256, rng.integers(1, 200), dtype=np.uint8)) if rng.random() < 0.7 else b"".join(alphabet[k] for k in rng.integers(0, 3, 5)) for _ in range(6)] for _ in range(50)]
    want = []
    for pieces in dumps:
        left, chain = list(range(1, 6)), [(0, None)]
        while left:
            score = [fragments.continuity(pieces[chain[-1][0]], pieces[j]) for j in left]
            k = int(np.argmax(score))
            chain.append((left.pop(k), score[k]))
        want.append(chain)
    overlap = fragments.overlap
    monkeypatch.setattr(fragments, "overlap", lambda *a: slow.append(a) or overlap(*a))
    size = np.array([[len(x) for x in d] for d in dumps])
    order, score = fragments.chains(np.tile(np.arange(6), (50, 1)), size, [[x[:64] for x in d] for d in dumps], [[x[-64:] for x in d] for d in dumps])
    assert [[i for i, _ in c] for c in want] == order.tolist()
    assert np.array_equal(score[:, 1:], [[s for _, s in c[1:]] for c in want]) and np.isnan(score[:, 0]).all()
    assert 0 < len(slow) < 50 * 15
