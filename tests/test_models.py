"""Quantile boosting and exact quantiles against brute force."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F
from ticklane.functions.quantiles import exact_quantiles
from ticklane.operators import quantile_trees as qt


@pytest.mark.parametrize("by", [None, "g"])
def test_exact_quantiles(spark, by):
    rng = np.random.default_rng(1)
    n = 8_000
    frame = pd.DataFrame({"a": rng.standard_cauchy(n), "b": np.round(rng.normal(size=n), 2), "c": np.where(rng.random(n) < 0.7, 3.0, rng.lognormal(0, 5, n)), "g": rng.integers(0, 3, n)})
    frame.loc[::7, "b"] = np.nan
    frame.loc[3, "a"] = np.inf
    qs = [0, 0.01, 0.25, 0.5, 0.9, 0.99, 1]
    found = exact_quantiles(spark.createDataFrame(frame).repartition(5), {x: qs for x in "abc"}, by)
    for k in [None] if by is None else range(3):
        part = frame if k is None else frame[frame.g == k]
        for x in "abc":
            v = part[x].to_numpy()
            assert np.allclose(found[k, x], np.quantile(v[np.isfinite(v)], qs), rtol=1e-12, atol=0)


def test_exact_quantiles_of_few_values(spark):
    rows = spark.createDataFrame([(1.5, None, "n"), (1.5, None, "n")], "a double, b double, c string")
    assert exact_quantiles(rows, {"a": [0.0, 0.5], "b": [0.5]}) == {(None, "a"): [1.5, 1.5], (None, "b"): [None]}
    assert exact_quantiles(rows.limit(0), {"a": [0.5]}) == {(None, "a"): [None]}


def market(n, seed=0):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 4))
    x[rng.random((n, 4)) < 0.05] = np.nan
    spread = 0.02 + 0.1 * (np.nan_to_num(x[:, 1]) > 0.5)
    y = 0.05 * np.nan_to_num(x[:, 0]) + spread * rng.standard_t(4, n)
    frame = pd.DataFrame(x, columns=["x0", "x1", "x2", "x3"]).assign(y=y, z=-np.abs(y), day=np.arange(n) * 10 // n, row=np.arange(n))
    frame.loc[::37, "y"] = np.nan
    return frame


def plain_forest(x, u, valid, q, how):
    """The same trees, row by row; x: bins, u: steps (-1 for none)."""
    train, late = (u >= 0) & ~valid, (u >= 0) & valid
    quantile = lambda v: sorted(v)[int(np.ceil(q * len(v) - 1e-9)) - 1]
    start = quantile(u[train])
    pred, trees, losses = np.full(len(u), start), [], []
    for number in range(how.rounds + 1):
        e = u - pred
        losses.append(q * np.maximum(e[late], 0).sum() + (1 - q) * np.maximum(-e[late], 0).sum())
        if number == how.rounds or len(losses) - 1 - int(np.argmin(losses)) >= how.patience:
            break
        node, splits = np.zeros(len(u), int), {}
        for depth in range(how.depth):
            for k in range(1 << depth):
                rows = train & (node == k)
                best = (1e-9, None)
                score = lambda m: ((e[m] < 0).sum() - q * m.sum()) ** 2 / max(m.sum(), 1)  # noqa: E731, B023
                for f in range(x.shape[1]):
                    for b in range(how.bins):
                        left, right = rows & (x[:, f] <= b), rows & (x[:, f] > b)
                        if min(left.sum(), right.sum()) >= how.least:
                            gain = score(left) + score(right) - score(rows)
                            if gain > best[0] + 1e-12:
                                best = (gain, (f, b))
                splits[depth, k] = best[1]
            node = np.array([2 * k + int(s is not None and x[i, s[0]] > s[1]) for i, (k, s) in enumerate((k, splits[depth, k]) for k in node)])
        value = {k: round(how.rate * quantile(e[train & (node == k)])) for k in set(node[train])}
        pred = pred + np.array([value.get(k, 0) for k in node])
        trees.append(value)
    return start, trees[: int(np.argmin(losses))], losses


@pytest.mark.parametrize("parts", [1, 7])
def test_quantile_trees_equal_plain_trees(spark, parts):
    frame = market(500)
    how = qt.Settings(rounds=6, depth=2, bins=8, least=15, patience=2, units=512)
    features = ["x0", "x1", "x2", "x3"]
    cuts = [list(np.quantile(frame[f].dropna(), np.arange(1, 8) / 8)) for f in features]
    rows = spark.createDataFrame(frame).replace(float("nan"), None).repartition(parts)
    made = qt.fit(rows, features, {"y": 0.7, "z": 0.1}, F.col("day") >= 8, how, cuts)
    x = qt.binned([frame[f].to_numpy() for f in features], cuts)
    for t, q in (("y", 0.7), ("z", 0.1)):
        v = frame[t].to_numpy()
        low, unit = np.nanmin(v), (np.nanmax(v) - np.nanmin(v)) / how.units
        u = np.where(np.isnan(v), -1, np.rint((np.nan_to_num(v) - low) / unit)).astype(int)
        start, trees, losses = plain_forest(x, u, frame.day.to_numpy() >= 8, q, how)
        forest = made[t]
        assert forest.start == start and np.allclose(forest.losses, losses) and len(forest.trees) == len(trees)
        for tree, value in zip(forest.trees, trees, strict=True):
            assert {k: int(v) for k, v in enumerate(tree.value) if k in value} == value
        again = qt.predict(qt.Forest.load(forest.dump()), rows, "p").select("row", "p").toPandas().sort_values("row")
        assert np.array_equal(again["p"].to_numpy(), forest.values(x))


def pinball(y, p, q):
    e = y - p
    return float(np.mean(np.maximum(q * e, (q - 1) * e)))


def test_quantile_trees_learn_and_stop(spark):
    frame = market(6_000, 3)
    rows = spark.createDataFrame(frame).replace(float("nan"), None)
    how = qt.Settings(rounds=30, depth=3, bins=16, least=30, patience=3)
    forest = qt.fit(rows.where("day < 8"), ["x0", "x1", "x2", "x3"], {"y": 0.9}, F.col("day") == 7, how)["y"]
    assert 2 <= len(forest.trees) < len(forest.losses) <= 31 and forest.losses[len(forest.trees)] == min(forest.losses)
    late = frame[(frame.day >= 8) & frame.y.notna()]
    p = forest.values(qt.binned([late[f].to_numpy() for f in forest.features], forest.cuts))
    flat = np.full(len(late), np.nanquantile(frame.y[frame.day < 7], 0.9))
    assert pinball(late.y, p, 0.9) < 0.9 * pinball(late.y, flat, 0.9) and 0.85 < (late.y <= p).mean() < 0.95


def test_quantile_trees_without_rows(spark):
    rows = spark.createDataFrame([], "x0 double, y double")
    forest = qt.fit(rows, ["x0"], {"y": 0.5}, None, qt.Settings(rounds=2), [[]])["y"]
    assert forest.values(np.zeros((3, 1), np.uint8)).tolist() == [0.0] * 3


# --- quantile boosting against the plain form


def test_boosting_beats_residual_bins_on_later_days(spark):
    from ticklane.operators import ml

    frame = market(8_000, 9)
    rows = spark.createDataFrame(frame).replace(float("nan"), None).where("y IS NOT NULL")
    features, late = ["x0", "x1", "x2", "x3"], rows.where("day >= 8")
    plain = ml.predict_quantile(ml.train_quantile(rows.where("day < 8"), features, "y", 0.9, maxIter=8, maxDepth=3), late, features, "p").toPandas()
    forest = qt.fit(rows.where("day < 8"), features, {"y": 0.9}, F.col("day") == 7, qt.Settings(least=30))["y"]
    boosted = qt.predict(forest, late, "p").toPandas()
    assert pinball(boosted.y, boosted.p, 0.9) < pinball(plain.y, plain.p, 0.9)


# --- artefacts


def trades(n=900, seed=2):
    rng = np.random.default_rng(seed)
    day = pd.Timestamp("2020-01-01") + pd.to_timedelta(rng.integers(0, 60, n), unit="D")
    frame = pd.DataFrame({"code": np.arange(n), "date": day.date, "strategy": rng.choice(["S1", "S2"], n), "a": rng.normal(size=n), "b": rng.normal(size=n)})
    return frame.assign(pnl_pct=0.1 * frame.a - 0.05 * (frame.b > 0) + 0.01 * rng.normal(size=n))


def test_artefact_round_trip(spark, tmp_path):
    from ticklane.operators import ml, training
    from ticklane.sources.sinks import load_model

    frame = spark.createDataFrame(trades())
    path = f"file://{tmp_path}/model"
    reports = training.train_and_report(frame, ["a", "b"], path, maxIter=8)
    metrics = reports["metrics"].first()
    assert metrics.pearson > 0.9 and metrics.samples == 900 and reports["quintiles"].count() == 5 and reports["quintiles_by"].count() == 10
    model, features, report = load_model(spark, path)
    scored = ml.predict(model, frame, features).toPandas()
    cuts = np.quantile(scored.prediction, [0.2, 0.4, 0.6, 0.8])
    assert np.allclose(report["bins"]["cuts"], cuts) and report["bins"]["std"] == pytest.approx(scored.prediction.std(ddof=0))
    later = trades(200, 7)
    got = training.score_candidates(spark, path, spark.createDataFrame(later), least=1).toPandas().sort_values("code")
    assert (got.predicted_bin_abs == 1 + np.searchsorted(cuts, got.prediction, side="left")).all() and (got.predicted_bin == got.predicted_bin_abs).all()
    for _, day in got.groupby("date"):
        r = day.prediction.rank(method="first").to_numpy() if day.prediction.is_unique else day.sort_values(["prediction", "code"]).reset_index().sort_values("code").index + 1
        ranked = day.sort_values(["prediction", "code"])
        place, n = np.arange(len(day)), len(day)
        assert len(r) == n and list(ranked.predicted_bin_rel) == [1 + sum(p * 5 > (n - 1) * j for j in range(1, 5)) for p in place]
    few = training.score_candidates(spark, path, spark.createDataFrame(later[["code", "date"]]), least=1).toPandas()
    assert few.prediction.isna().all() and (few[["predicted_bin_abs", "predicted_bin_rel"]] == 0).all().all()
    keys = spark.createDataFrame(later[["code", "date"]].head(5)).unionByName(spark.createDataFrame([(99_999, later.date[0])], "code long, date date"))
    assert training.score_keys(spark, path, spark.createDataFrame(later), keys).count() == 6


def test_bins_of_missing_predictions(spark):
    from ticklane.operators import training

    rows = spark.createDataFrame([(1, "d", 0.5), (2, "d", None), (3, "d", float("nan")), (4, "d", 0.1)], "code int, date string, prediction double")
    fitted = training.fit_bins(rows.limit(0))
    assert fitted["cuts"] == []
    found = {r.code: (r.predicted_bin_abs, r.predicted_bin_rel) for r in training.apply_bins(rows, training.fit_bins(rows)).collect()}
    assert found[2] == found[3] == (0, 0) and found[4] == (1, 1) and found[1] == (5, 5)


# --- sequences


def sequence_rows(spark):
    rng = np.random.default_rng(6)
    rows = []
    for day in range(24):
        for code in range(40):
            seq = rng.normal(size=(21, 2))
            drive = seq[-5:, 0].mean() * 2
            ret = 0.05 * drive + 0.02 * rng.normal()
            rows.append((code, day, [[float(v) for v in r] for r in seq], 2 if ret > 0.04 else 0 if ret < -0.04 else 1, float(ret)))
    rows[3] = (*rows[3][:2], [[float("nan"), None]] * 21, *rows[3][3:])
    return spark.createDataFrame(rows, "code int, date int, seq array<array<double>>, label int, ret double").coalesce(2)


def test_sequences_stop_by_the_top_of_a_day(spark):
    from ticklane.operators import sequence_model as sm
    from ticklane.operators.metrics import topfrac_hit

    rows = sequence_rows(spark)
    how = sm.Training(hidden=(16,), epochs=8, steps=4, patience=2, least=20)
    one = sm.train_sequences(rows.where("date < 18"), "seq", "label", "ret", F.col("date") >= 13, how)
    assert len(one.hits) <= 8 and one.hits[one.best_epoch - 1] == max(one.hits) and (len(one.hits) == 8 or len(one.hits) == one.best_epoch + 2)
    late = sm.upper(one.model, rows.where("date >= 18"), "seq")
    assert set(late.columns) == {"code", "date", "seq", "label", "ret", "_probs", "prob"}
    hit = topfrac_hit(late, "prob", "ret", 0.1, 0.0, 20).first()
    assert hit.days == 6 and hit.topfrac_hit > 0.75
    again = sm.train_sequences(rows.where("date < 18"), "seq", "label", "ret", F.col("date") >= 13, how)
    assert again.best_epoch == one.best_epoch and np.allclose(again.hits, one.hits)
    without = sm.train_sequences(rows.where("date < 18"), "seq", "label", "ret", F.lit(False), sm.Training(hidden=(4,), epochs=3, steps=1, patience=1))
    assert without.best_epoch == 1


# --- similar windows


def window_rows(n, seed, width=14):
    import datetime as dt

    rng = np.random.default_rng(seed)
    base = rng.normal(size=(n, 3)) @ rng.normal(size=(3, width)) + 0.05 * rng.normal(size=(n, width))
    base[5] = base[9] = base[2]  # ties
    rows = [(int(k % 7), dt.date(2020, 1, 1) + dt.timedelta(days=k), dt.date(2020, 1, 7) + dt.timedelta(days=k), [float(v) for v in base[k]], int(k % 6)) for k in range(n)]
    return rows


def test_window_search_equals_brute_force(spark):
    from ticklane.operators import similarity

    kind = "code int, start_date date, end_date date, vec array<double>, future_days long"
    rows = window_rows(4_000, 1)
    bad = [(1, rows[0][1], rows[0][2], None, 0), (1, rows[0][1], rows[0][2], [None] * 14, 0)]
    asked = [rows[k] for k in (2, 77, 3_999)] + [(50, rows[0][1], rows[0][2], [9.0] * 14, 0)]
    targets = spark.createDataFrame([(r[0], r[2], r[3]) for r in asked] + [(60, rows[0][2], None)], "target_code int, target_end date, target_vec array<double>")
    index = similarity.build_index(spark.createDataFrame(rows + bad, kind).repartition(3))
    assert len(index.cells) > 50
    for top, least in ((10, None), (5, 0.6), (4_100, None)):
        found, counts = similarity.search(index, targets, top, least)
        got = {}
        for r in found.orderBy("target_code", "target_end", "place").collect():
            got.setdefault((r.target_code, r.target_end), []).append((r.code, r.start_date, r.similarity, r.future_days))
        for code, _, end, vec, _ in asked:
            like = [(-round(1 / (1 + float(np.sqrt(((np.array(v) - np.array(vec)) ** 2).sum()))), 9), c, s, left) for c, s, e, v, left in rows if (c, e) != (code, end)]
            best = [(c, s, -x, left) for x, c, s, left in sorted(x for x in like if least is None or -x[0] >= least)[:top]]
            assert [x[:2] for x in got.get((code, end), [])] == [x[:2] for x in best] and np.allclose([x[2] for x in got.get((code, end), [])], [x[2] for x in best], atol=2e-9)
        assert counts["pairs"] == 16_000 and (top > 100 or counts["distances"] * 5 < counts["pairs"])
    empty = similarity.build_index(spark.createDataFrame([], kind))
    assert similarity.search(empty, targets)[0].count() == 0
    one = similarity.build_index(spark.createDataFrame(rows[:1], kind))
    assert similarity.search(one, targets)[0].count() == 4


def test_search_of_packed_bars_equals_brute_force(spark):
    """Ties, windows with missing cells, short codes, a first close of 0, codes longer than a piece; charts of what is found, too."""
    import datetime as dt

    from ticklane.operators import similarity

    rng, day0 = np.random.default_rng(5), dt.date(2024, 1, 1)
    rows = []
    for c in range(9):
        close = 100 + np.cumsum(rng.integers(-2, 3, 30 * c + 4))
        for k, x in enumerate(close.astype(float).tolist()):
            p = 0.0 if (c, k) == (2, 9) else x if c != 8 else 100.0
            rows.append((c, day0 + dt.timedelta(days=k), p, p + 1, p - 1, None if (c, k) == (3, 20) else p, p - 0.5, 0.01 * (k % 3), 0.02 * (k % 2)))
    rows += [(20, *r[1:]) for r in rows if r[0] == 4]  # a copy: ties
    bars = spark.createDataFrame(rows, "code long, date date, open double, high double, low double, close double, preclose double, turnover double, pct_chg double").repartition(5)
    vectors, packed = similarity.window_vectors(bars), similarity.pack_bars(bars)
    made = [r for r in vectors.collect() if r.vec is not None and None not in r.vec]
    again = {(r.code, r.end_date): (r.start_date, r.vec, r.future_days) for r in similarity.packed_vectors(packed).collect() if None not in r.vec}
    assert again == {(r.code, r.end_date): (r.start_date, r.vec, r.future_days) for r in made}
    asked = [r for r in made if r.code in (1, 4, 8) and r.end_date.day == 20]
    targets = spark.createDataFrame([(r.code, r.end_date, r.vec) for r in asked] + [(60, day0, None)], "target_code long, target_end date, target_vec array<double>")
    for top, least in ((10, None), (5, 0.6), (5_000, None)):
        found = similarity.search_packed(packed, targets, top, least)
        got = {}
        for r in found.orderBy("target_code", "target_end", "place").collect():
            got.setdefault((r.target_code, r.target_end), []).append((r.code, r.start_date, r.end_date, r.similarity, r.future_days))
        for t in asked:
            like = [(-similarity._rounded(float(np.sqrt(sum((a - b) * (a - b) for a, b in zip(r.vec, t.vec, strict=True))))), r.code, r.start_date, r.end_date, r.future_days) for r in made if (r.code, r.end_date) != (t.code, t.end_date)]
            best = [(c, s, e, -x, f) for x, c, s, e, f in sorted(x for x in like if least is None or -x[0] >= least)[:top]]
            assert got.get((t.code, t.end_date), []) == best
        shown = similarity.packed_rows(packed, found)
        plain = similarity.window_rows(bars, found)
        assert sorted(map(repr, shown.select(*plain.columns).collect())) == sorted(map(repr, plain.collect()))
    assert similarity.search_packed(packed.where("code < 0"), targets).count() == 0


def test_similar_windows_are_written_nowhere(spark, monkeypatch):
    """What the queries of similar windows write are bars, a row a code, and what they found: no row a window."""
    from conftest import SMALL
    from ticklane.plans import trade_queries as tq

    kept = []
    for module in (tq, tq.similarity):
        monkeypatch.setattr(module, "written", lambda df, *a, real=module.written: kept.append(real(df, *a)) or kept[-1])
    monkeypatch.setattr(tq.similarity, "scratch_path", lambda *_: pytest.fail("an index was written"))
    rows = tq.similar_rows(spark, SMALL).count()
    bars = tq.bars(spark, SMALL)
    assert rows and all(x.count() < bars.count() / 3 for x in kept) and sum(x.selectExpr("sum(size(date))").first()[0] for x in kept if "open" in x.columns) == bars.count()


def test_packed_sequences_are_those_of_windows(spark):
    """Codes with too few rows, incomplete rows and cells that are no numbers; each row's cells lie in the scratch files once."""
    from ticklane.operators import labels as lb

    day0 = pd.Timestamp("2024-01-01").date()
    rows = [(c, day0 + pd.Timedelta(days=k), float(c * 100 + k), None if (c + k) % 7 == 0 else float("nan") if k == 4 else k / 2.0, k % 3, k * 1.5) for c in range(4) for k in range(3 + 4 * c)]
    frame = spark.createDataFrame(rows, "code long, date date, a double, b double, label int, fwd double")
    packed = lb.pack_sequences(frame, ["a", "b"], ["label", "fwd"], 5)
    found = lb.unpack_sequences(packed, 2, ["label", "fwd"], 5).orderBy("code", "date").collect()
    line = {}
    for c, day, a, b, label, fwd in rows:
        if b is not None and b == b:
            line.setdefault(c, []).append((day, [a, b], label, fwd))
    wanted = [(c, x[i][0], x[i][2], x[i][3], sum((r[1] for r in x[i - 4 : i + 1]), [])) for c, x in sorted(line.items()) for i in range(4, len(x))]
    assert [tuple(r) for r in found] == wanted and wanted
    assert packed.selectExpr("sum(size(_cells)) AS n").first().n == sum(2 * len(x) for x in line.values() if len(x) >= 5)


def test_training_on_sequences_writes_none(spark, monkeypatch):
    from pyspark.sql import DataFrameWriter
    from ticklane.operators import sequence_model as sm

    monkeypatch.setattr(DataFrameWriter, "parquet", lambda *_, **__: pytest.fail("sequences were written"))
    rows = sequence_rows(spark)
    assert sm.train_sequences(rows.where("date < 18"), "seq", "label", "ret", F.col("date") >= 13, sm.Training(hidden=(4,), epochs=1, steps=1, least=20)).best_epoch == 1
