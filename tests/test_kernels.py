import numpy as np
import pytest

from strandlake.kernels import dp
from strandlake.kernels import geometry as G
from strandlake.kernels import search as S
from strandlake.options import ClusterOptions, ReadOptions, SearchOptions

RNG = np.random.default_rng(0)


def walk(n, g=RNG):
    v = g.normal(size=(n, 3))
    return np.cumsum(3.8 * v / np.linalg.norm(v, axis=1, keepdims=True), axis=0)


def letters(n, g=RNG):
    return "".join(g.choice(list("ACDEFGHIKLMNPQRSTVWY"), n))


def turned(x, g=RNG):
    rot, _ = G.superpose(walk(6, g), walk(6, g))
    return x @ rot.T + np.array([5.0, -3.0, 9.0])


def test_superposition_finds_the_transform_and_is_proper():
    a = walk(30)
    b = turned(a)
    rot, shift = G.superpose(a, b)
    assert np.allclose(G.move(a, rot, shift), b, atol=1e-8)
    back = G.invert(rot, shift)
    assert np.allclose(G.move(b, *back), a, atol=1e-8)
    assert np.linalg.det(rot) == pytest.approx(1)
    assert G.rmsd(a, b) == pytest.approx(0, abs=1e-6)


@pytest.mark.parametrize("points", [np.zeros((4, 3)), np.outer(np.arange(5), [1.0, 0, 0]), np.eye(3)])
def test_degenerate_points_give_a_rotation(points):
    rot, shift = G.superpose(points, points[::-1].copy())
    assert np.isfinite(rot).all() and np.isfinite(shift).all()
    assert np.linalg.det(rot) == pytest.approx(1)


def test_d0_of_the_published_lengths():
    assert [round(G.d0_final(n, "Protein"), 2) for n in (81, 84, 1042)] == [3.21, 3.29, 10.71]
    assert G.d0_final(10, "NA") == 0.3 and G.d0_final(25, "NA") == 0.7


def test_ideal_helix_and_strand():
    k = np.arange(60)
    helix = np.column_stack([2.3 * np.cos(np.radians(100) * k), 2.3 * np.sin(np.radians(100) * k), 1.5 * k])
    assert set(G.secondary_structure(helix)[2:-2]) == {"h"}
    strand = np.column_stack([3.3 * k, 0.95 * (k % 2), 0 * k])
    assert set(G.secondary_structure(strand)[2:-2]) == {"e"}
    assert G.secondary_structure(helix[:4]) == "    "


def test_hairpin_pairs():
    n = 6
    left = np.column_stack([6.0 * np.arange(n), np.zeros(n), np.zeros(n)])
    right = np.column_stack([6.0 * np.arange(n)[::-1], np.full(n, 13.75), np.zeros(n)])
    loop = np.array([[40.0, 30, 30], [60, 40, 40], [80, 60, 60], [60, 80, 80]])
    s = G.base_pairs(np.concatenate([left, loop, right]), "GGAACC" + "AAAA" + "GGUUCC")
    assert s == "((((((....))))))"


def test_alignment_score_matches_its_path():
    for _ in range(30):
        x = RNG.normal(size=(RNG.integers(3, 25), RNG.integers(3, 25)))
        i, j, v = dp.align(x, 0.6)
        opened = sum(int(a > 1) + int(b > 1) for a, b in zip(np.diff(i), np.diff(j)))
        assert v == pytest.approx(x[i, j].sum() - 0.6 * opened)
        assert v == pytest.approx(dp.score_only(x, 0.6))
        assert (np.diff(i) > 0).all() and (np.diff(j) > 0).all()


def brute_align(x, gap):
    """All monotone paths, by memo over matched cells."""
    from functools import lru_cache

    n, m = x.shape

    @lru_cache(None)
    def best(i, j):  # best from cell (i, j), which is matched
        out = x[i, j]
        more = [0.0]
        for a in range(i + 1, n):
            for b in range(j + 1, m):
                more.append(best(a, b) - gap * ((a > i + 1) + (b > j + 1)))
        return out + max(more)

    return max([0.0, *(best(i, j) for i in range(n) for j in range(m))])


def test_alignment_is_optimal_on_small_matrices():
    for _ in range(20):
        x = RNG.normal(size=(RNG.integers(1, 7), RNG.integers(1, 7)))
        v = dp.align(x, 0.6)[2]
        assert v == pytest.approx(brute_align(x, 0.6))


def test_local_alignment_and_ungapped_run():
    x = np.where(RNG.random((12, 14)) < 0.4, 1.0, -1.0)
    v = dp.local(x, 0.8)
    w = np.zeros((13, 15))
    for i in range(1, 13):
        for j in range(1, 15):
            w[i, j] = max(0, x[i - 1, j - 1] + w[i - 1, j - 1], w[i - 1, j] - 0.8, w[i, j - 1] - 0.8)
    assert np.allclose(v, w[1:, 1:])
    s = RNG.normal(size=40)
    assert dp.ungapped(s) == pytest.approx(max(0, max(s[a:b].sum() for a in range(40) for b in range(a + 1, 41))))


def test_longest_increasing_gain():
    for _ in range(30):
        t, g = RNG.integers(0, 8, 10), RNG.random(10)
        got = S.increasing(t, g)
        assert (np.diff(t[got]) > 0).all()
        best = 0
        for mask in range(1 << 10):
            own = [k for k in range(10) if mask >> k & 1]
            if all(t[a] < t[b] for a, b in zip(own, own[1:])):
                best = max(best, g[own].sum())
        assert g[got].sum() == pytest.approx(best)


@pytest.mark.parametrize("speed", [None, 0, 10, 13])
def test_a_moved_copy_is_found(speed):
    o = SearchOptions() if speed is None else SearchOptions().at_speed(speed)
    a, s = walk(60), letters(60)
    h = S.align_pair(S.Chain(a, s, "Protein"), S.Chain(turned(a), s, "Protein"), o)
    assert h["tmscore_refn"] == pytest.approx(1, abs=1e-6) and h["rmsd"] == pytest.approx(0, abs=1e-5)
    assert h["n_identities"] == 60 and h["n_gaps"] == 0 and h["query_aln"] == s == h["refn_aln"]
    assert np.linalg.det(np.array(h["rotation"]).reshape(3, 3)) == pytest.approx(1)


def test_a_deletion_is_one_gap_and_no_deletions_hides_it():
    a, s = walk(80), letters(80)
    b, t = turned(np.concatenate([a[:30], a[40:]])), s[:30] + s[40:]
    h = S.align_pair(S.Chain(a, s, "Protein"), S.Chain(b, t, "Protein"), SearchOptions())
    assert h["n_aligned"] == 70 and h["n_gaps"] == 10 and "-" * 10 in h["refn_aln"]
    assert h["tmscore_refn"] == pytest.approx(1) and h["tmscore_query"] == pytest.approx(70 / 80)
    h = S.align_pair(S.Chain(b, t, "Protein"), S.Chain(a, s, "Protein"), SearchOptions(no_deletions=True))
    assert "-" not in h["query_aln"]


def test_mirror_types_screen_reference_and_symmetry():
    a, s = walk(50), letters(50)
    m = S.align_pair(S.Chain(a, s, "Protein"), S.Chain(a * [1, 1, -1], s, "Protein"), SearchOptions(pre_score=0, score_threshold=0))
    assert m["tmscore_refn"] < 0.99 and np.linalg.det(np.array(m["rotation"]).reshape(3, 3)) == pytest.approx(1)
    assert S.align_pair(S.Chain(a, s, "Protein"), S.Chain(a, s, "NA"), SearchOptions()) is None
    assert S.align_pair(S.Chain(a, s, "Protein"), S.Chain(walk(45), letters(45), "Protein"), SearchOptions(pre_score=0.9)) is None
    b = turned(a) + RNG.normal(0, 0.5, a.shape)
    x = S.align_pair(S.Chain(a, s, "Protein"), S.Chain(b[:44], s[:44], "Protein"), SearchOptions(symmetric=True))
    y = S.align_pair(S.Chain(b[:44], s[:44], "Protein"), S.Chain(a, s, "Protein"), SearchOptions(symmetric=True))
    assert x["query_aln"] == y["refn_aln"] and x["refn_aln"] == y["query_aln"]
    r = S.align_pair(S.Chain(a, s, "Protein"), S.Chain(b, s, "Protein"), SearchOptions(referenced=True))
    moved = G.move(b, np.array(r["rotation"]).reshape(3, 3), np.array(r["translation"]))
    assert np.sqrt(((moved - a) ** 2).sum(1).mean()) < 2


def test_options_are_checked():
    assert SearchOptions().at_speed(13).detailed is False and SearchOptions().at_speed(0).nbranches == 16
    for bad in ({"score_threshold": 1.0}, {"sort": "tm2_refn"}, {"window": 300}, {"wrap": 10}, {"nbranches": 17}):
        with pytest.raises(ValueError):
            SearchOptions(**bad)
    with pytest.raises(ValueError):
        ClusterOptions(threshold=2)
    assert ClusterOptions(threshold=2, measure="rmsd").cut == 2 and ClusterOptions(threshold=0.75).cut == pytest.approx(0.25)
    with pytest.raises(ValueError):
        ReadOptions(ter=3, split=2)


def exhaustive_score(pair):
    """The best score over superpositions of all equally long fragments of three places and more, each aligned and improved."""
    best = 0.0
    q, r = pair.q, pair.r
    for size in range(3, pair.n + 1):
        for a in range(q.n - size + 1):
            for b in range(r.n - size + 1):
                rot, shift = G.superpose(q.xyz[a : a + size], r.xyz[b : b + size])
                for _ in range(4):
                    i, j, _ = dp.align(pair.scores_at(rot, shift), 0.0)
                    if len(i) < 3:
                        break
                    best = max(best, pair.value(i, j, rot, shift)[0])
                    v, rot, shift = pair.refine(i, j)
                    best = max(best, v)
    return best


def test_search_is_near_the_exhaustive_best_on_short_chains():
    g = np.random.default_rng(12)
    options = SearchOptions(pre_score=0, score_threshold=0, refinement="full", seed_rule=0).at_speed(0)
    for k in range(8):
        a = walk(int(g.integers(8, 13)), g)
        b = turned(a, g)[1:] + g.normal(0, 0.7, (len(a) - 1, 3)) if k % 2 else walk(int(g.integers(8, 13)), g)
        pair = S.Pair(S.Chain(a, "A" * len(a), "Protein"), S.Chain(b, "A" * len(b), "Protein"), options)
        assert pair.search()[0] >= 0.95 * exhaustive_score(pair)


def test_refinement_levels_only_gain():
    g = np.random.default_rng(13)
    for _ in range(4):
        a = walk(60, g)
        b = turned(a, g) + g.normal(0, 2.5, a.shape)
        got = [S.Pair(S.Chain(a, "A" * 60, "Protein"), S.Chain(b, "A" * 60, "Protein"), SearchOptions(pre_score=0, score_threshold=0, refinement=level)).search()[0] for level in ("one", "few", "full")]
        assert got[0] <= got[1] + 1e-12 and got[1] <= got[2] + 1e-12


def helices(n, g):
    """Ideal helices with loops between them, so that secondary structure says something."""
    t = np.arange(n)
    x = np.column_stack([2.3 * np.cos(np.radians(100) * t), 2.3 * np.sin(np.radians(100) * t), 1.5 * t])
    for cut in range(15, n, 20):
        turn = np.linalg.qr(g.normal(size=(3, 3)))[0]
        x[cut:] = (x[cut:] - x[cut]) @ turn.T + x[cut - 1] + np.array([3.8, 0, 0])
    return x


@pytest.mark.parametrize("rule", [0, 64, 128])
def test_seed_rules_trigger_and_sections(rule):
    g = np.random.default_rng(14)
    a = helices(90, g)
    b = turned(np.concatenate([a[:40], a[55:]]), g)
    chains = S.Chain(a, "A" * 90, "Protein"), S.Chain(b, "A" * 75, "Protein")
    for depth in ("deep", "high", "shallow"):
        options = SearchOptions(pre_score=0, score_threshold=0, seed_rule=rule, depth=depth, trigger=20)
        pair = S.Pair(*chains, options)
        places = pair.seed_frames()
        assert places and all(p[0] % S.rules.step_size(90, depth) == 0 and p[1] % S.rules.step_size(75, depth) == 0 for p in places)
        assert len(S.Pair(*chains, SearchOptions(seed_rule=rule, depth=depth, trigger=100)).seed_frames()) <= len(places)
        assert S.rules.sections(depth) == {"deep": 3, "high": 2, "shallow": 1}[depth]
        seeds = pair.seeds()
        assert 0 < len(seeds) <= 3 * options.nbranches and max(t[0] for t in seeds) > 0.3
    assert S.Pair(S.Chain(a, "A" * 90, "NA", "." * 90), S.Chain(b, "A" * 75, "NA", "." * 75), SearchOptions(seed_rule=rule)).frame() == (128 if rule else 0)


def test_index_alignment_either_way_and_in_a_window():
    g = np.random.default_rng(15)
    a = walk(70, g)
    for x, y in ((a, a[10:50]), (a[10:50], a)):
        q, r = S.Chain(x, "A" * len(x), "Protein"), S.Chain(turned(y, g), "A" * len(y), "Protein")
        pair = S.Pair(q, r, SearchOptions())
        i, j = (np.arange(10, 20), np.arange(10)) if len(x) > len(y) else (np.arange(10), np.arange(10, 20))
        rot, shift = G.superpose(q.xyz[i], r.xyz[j])
        v, i, j, *_ = pair.index_score(rot, shift, int(i[0]), int(j[0]))
        assert v == pytest.approx(1.0) and len(i) == 40 and (i - j == i[0] - j[0]).all()
    long = walk(600, g)
    q, r = S.Chain(long, "A" * 600, "Protein"), S.Chain(turned(long, g), "A" * 600, "Protein")
    rot, shift = G.superpose(q.xyz, r.xyz)
    for window in (256, 512):
        v, i, *_ = S.Pair(q, r, SearchOptions(window=window)).index_score(rot, shift, 300, 300)
        assert len(i) == window and i[0] == 300 - window // 2


def test_rules_are_those_of_the_columns(spark):
    from pyspark.sql import functions as F

    from strandlake.functions import scalar
    from strandlake.kernels import rules

    n = F.col("id").cast("int")
    cols = [scalar.step_size(n, d) for d in ("deep", "high", "medium", "shallow")] + [scalar.seed_length(n, F.lit(500), w) for w in (0, 1)] + [scalar.seed_length(n, F.lit(500), 1, f) for f in (64, 128)] + [scalar.fragment_length(n, level) for level in range(1, 6)]
    for r in spark.range(3, 400, 7).select("id", *[c.alias(f"c{k}") for k, c in enumerate(cols)]).collect():
        want = [rules.step_size(r.id, d) for d in ("deep", "high", "medium", "shallow")] + [rules.seed_length(r.id, w) for w in (0, 1)] + [rules.seed_length(r.id, 1, f) for f in (64, 128)] + [rules.fragment_length(r.id, level) for level in range(1, 6)]
        assert list(r[1:]) == want, r.id
    assert S.similarity("ACDE" * 10, "ACDE" * 10) > 0


def test_block_maxima_against_slices():
    from strandlake.kernels.search import block_maxima

    g = np.random.default_rng(31)
    for _ in range(40):
        n, m, size = (int(x) for x in g.integers(1, 30, 3))
        v = g.normal(size=(n, m))
        assert (block_maxima(v, size) == [[v[a : a + size, b : b + size].max(initial=0) for b in range(m)] for a in range(n)]).all()


def test_symmetric_pairs_of_one_length_and_sequence():
    g = np.random.default_rng(32)
    a, b, s = walk(60, g), walk(60, g), letters(60, g)
    options = SearchOptions(pre_score=0.0, score_threshold=0.0, symmetric=True).at_speed(9)
    one, two = (S.align_pair(S.Chain(x, s, "Protein", None), S.Chain(y, s, "Protein", None), options) for x, y in ((a, b), (b, a)))
    assert one["tmscore_query"] == pytest.approx(two["tmscore_refn"]) and one["n_aligned"] == two["n_aligned"]


def test_packed_alignment_is_the_same():
    g = np.random.default_rng(33)
    for k in range(400):
        n, m = (int(x) for x in g.integers(1, 40, 2))
        score = g.integers(-2, 3, (n, m)).astype(float) if k % 2 else g.normal(-0.2, 1, (n, m))
        gap = float(g.choice([0.0, 0.6, 1.0, 2.0]))
        rows = lambda a, b: score[a:b]  # noqa: E731, B023
        want, got = dp.align(score, gap), dp.align_packed(rows, n, m, gap)
        assert got[2] == want[2] and (got[0].tolist(), got[1].tolist()) == (want[0].tolist(), want[1].tolist())
        assert dp.score_packed(rows, n, m, gap) == dp.score_only(score, gap)


def test_long_pairs_without_whole_matrices_give_the_same_hits(monkeypatch):
    g = np.random.default_rng(34)
    a, b = walk(70, g), walk(55, g)
    for options in (SearchOptions(pre_score=0.0, score_threshold=0.0).at_speed(13), SearchOptions(pre_score=0.0, score_threshold=0.0, search_by_ss=True, depth="high")):
        hits = []
        for cells in (10**9, 0):
            monkeypatch.setattr(S, "WHOLE_CELLS", cells)
            hits.append(S.align_pair(S.Chain(a, letters(70, np.random.default_rng(1)), "Protein"), S.Chain(b, letters(55, np.random.default_rng(2)), "Protein"), options))
        assert hits[0]["query_aln"] == hits[1]["query_aln"] and hits[0]["tmscore_query"] == pytest.approx(hits[1]["tmscore_query"])


def test_a_long_alignment_takes_half_a_byte_a_cell():
    import tracemalloc

    n, m = 3000, 6000
    place = np.arange(m)
    tracemalloc.start()
    i, j, total = dp.align_packed(lambda a, b: np.where(place[None, :] == 2 * np.arange(a, b)[:, None], 1.0, -1.0), n, m, 0.0)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert total == n and (j == 2 * i).all() and most < n * m / 2 + 12_000_000


def test_pairs_together_give_what_each_gives_alone(monkeypatch):
    g = np.random.default_rng(12)
    chains = [S.Chain(walk(n, g), letters(n, g), "Protein") for n in (3, 24, 40, 41, 60, 7, 33)]
    pairs = [(a, b, k) for k, (a, b) in enumerate((a, b) for a in chains for b in chains)] + [(chains[1], S.Chain(walk(20, g), "ACGU" * 5, "NA"), 49)]
    monkeypatch.setattr(S, "SIDE_BY_SIDE_CELLS", 5_000)
    monkeypatch.setattr(S, "TOGETHER_CELLS", 20_000)
    for options in (SearchOptions(pre_score=0.2, score_threshold=0).at_speed(13), SearchOptions(pre_score=0, score_threshold=0, symmetric=True).at_speed(9)):
        got = list(S.align_pairs(iter(pairs), options))
        assert [p[2] for p, _ in got] == list(range(50)) and got[-1][1] is None
        for (q, r, _), hit in got:
            alone = S.align_pair(q, r, options)
            assert (hit is None) == (alone is None) and (hit is None or hit["query_aln"] == alone["query_aln"] and hit["tmscore_query"] == pytest.approx(alone["tmscore_query"], abs=1e-9))


def test_matrices_side_by_side():
    g = np.random.default_rng(3)
    for levels in (2, 1000):
        scores = [g.integers(-levels, levels, (g.integers(1, 30), g.integers(1, 30))) / levels for _ in range(60)]
        opens = [float(g.choice([0.0, 0.5, 0.6])) for _ in scores]
        for s, gap, (i, j) in zip(scores, opens, S.dp.align_many(scores, opens)):
            x, y, _ = S.dp.align(s, gap)
            assert i.tolist() == x.tolist() and j.tolist() == y.tolist()
        for s, gap in zip(scores, opens):
            assert S.dp.totals(np.stack([s, -s], axis=1), gap).tolist() == [S.dp.score_only(s, gap), S.dp.score_only(-s, gap)]


def test_rotations_of_many():
    g = np.random.default_rng(4)
    cov = g.normal(0, 1, (400, 3, 3)) * 10.0 ** g.integers(-6, 7, (400, 1, 1))
    cov[:40, 2] = 0  # planar
    cov[40:60, 1:] = 0  # collinear
    cov[60] = 0
    cov[61] = np.diag([1.0, 1.0, -1.0])
    rot = G.rotations(cov)
    assert np.allclose(np.linalg.det(rot), 1) and np.allclose(rot @ np.swapaxes(rot, 1, 2), np.eye(3))
    gain = lambda r: np.einsum("bij,bji->b", r, cov)
    assert np.allclose(gain(rot), gain(G._by_singular_vectors(cov)), rtol=1e-9, atol=1e-15)


def test_a_copy_without_its_middle_is_found_by_diagonals():
    # Superposed on whole diagonals this chain, of which ten positions are missing after the middle, was aligned elsewhere (19 places before).
    x = [-2.406, 0.468, -0.006, -2.187, -5.912, -6.179, -3.944, -3.614, -3.886, -7.427, -9.29, -6.18, -8.518, -7.72, -9.156, -6.433, -2.846, -1.294, -2.635, -0.027, 1.825, 3.636, 0.276, 0.44, -0.729, -1.687, -0.382, -1.514, -1.245, -3.13, -3.948, -7.279, -4.278, -1.088, -0.898, -2.963]
    y = [1.521, 3.941, 0.901, -1.044, -0.428, 2.381, 3.706, 2.0, 2.015, 2.804, 6.085, 4.209, 1.358, 4.979, 1.806, -0.686, -0.112, 2.878, -0.176, -0.534, -0.767, -0.135, -1.87, -2.133, -5.684, -8.442, -5.137, -3.016, -3.619, -0.373, 0.004, -0.995, 0.971, -0.993, 0.672, 3.63]
    z = [2.517, 1.948, 4.178, 1.749, 2.184, -0.361, -3.134, 0.246, 4.036, 5.166, 5.616, 6.732, 5.816, 4.987, 3.467, 2.563, 3.676, 5.435, 7.254, 9.994, 13.305, 10.024, 9.651, 5.864, 5.185, 2.753, 1.407, 4.349, 0.607, 0.011, -3.681, -5.213, -6.467, -7.105, -10.516, -9.32]
    points, kept = np.column_stack([x, y, z]), [k for k in range(36) if not 18 <= k < 28]
    rot, shift = np.array([[0.36, 0.48, -0.8], [-0.8, 0.6, 0.0], [0.48, 0.64, 0.6]]), np.array([1.0, 2.0, -3.0])
    h = S.align_pair(S.Chain(points, "GCAU" * 9, "NA"), S.Chain((points @ rot.T + shift)[kept], "".join(("GCAU" * 9)[k] for k in kept), "NA"), SearchOptions(score_threshold=0, pre_score=0).at_speed(13))
    assert (h["n_aligned"], h["query_from"], h["query_to"], h["refn_to"]) == (26, 1, 36, 26) and h["tmscore_refn"] == pytest.approx(1, abs=1e-4) and h["rmsd"] < 1e-3


def test_a_whole_match_ends_the_search(monkeypatch):
    g = np.random.default_rng(21)
    xyz = np.cumsum(g.normal(0, 2, (50, 3)), axis=0)
    seq = letters(50, g)
    turn = np.array([[0.36, 0.48, -0.8], [-0.8, 0.6, 0.0], [0.48, 0.64, 0.6]])
    keep = np.r_[0:25, 35:50]
    q, r = S.Chain(xyz, seq, "Protein"), S.Chain((xyz @ turn.T + 3)[keep], "".join(seq[k] for k in keep), "Protein")
    o = SearchOptions(score_threshold=0.0, pre_score=0.0, refinement="full").at_speed(0)
    monkeypatch.setattr(S.Pair, "seeds", lambda self: pytest.fail("seeds of a pair that matches whole"))
    hit = S.align_pair(q, r, o)
    assert hit["n_aligned"] == 40 and hit["n_gaps"] == 10 and hit["tmscore_refn"] == pytest.approx(1, abs=1e-9) and hit["rmsd"] < 1e-6


def test_terms_of_a_pair_are_products_of_its_sides(monkeypatch):
    g = np.random.default_rng(41)
    q, r = S.Chain(g.normal(0, 9, (31, 3)), "A" * 31, "Protein"), S.Chain(g.normal(0, 9, (24, 3)), "A" * 24, "Protein")
    pair = S.Pair(q, r, SearchOptions())
    for shape in ((19,), (7, 19)):
        i, j = g.integers(0, 31, shape), g.integers(0, 24, shape)
        a, b = q.xyz[i] - q.middle, r.xyz[j] - r.middle
        terms, squares = pair.terms(i, j)
        want = np.concatenate([np.ones((*shape, 1)), a, b, (a[..., :, None] * b[..., None, :]).reshape(*shape, 9)], axis=-1)
        assert (terms == want).all() and (squares == (a * a).sum(-1) + (b * b).sum(-1)).all()
    made = []
    whole = S.np.repeat
    monkeypatch.setattr(S.np, "repeat", lambda *a, **k: made.append(1) or whole(*a, **k))
    S.align_pair(q, S.Chain(q.xyz[4:28] + g.normal(0, 0.5, (24, 3)), "A" * 24, "Protein"), SearchOptions(score_threshold=0.0, pre_score=0.0).at_speed(13))
    assert len(made) == 1  # what the positions bring is worked out once, for all stages and final scores
