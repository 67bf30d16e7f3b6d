"""What holds for the results of queries that have no SQL; each law takes the collected rows."""

from __future__ import annotations

from collections import defaultdict


def _unique(rows, *keys) -> bool:
    return len({tuple(r[k] for k in keys) for r in rows}) == len(rows)


def _is_class(label: str, pred: str):
    """Every row has a class that labels have, with a probability."""
    return lambda rows: _unique(rows, "vec_id") and all(r[pred] in {x[label] for x in rows} and 0 < r[f"{pred}_prob"] <= 1 for r in rows)


def _hierarchy(rows) -> bool:
    """Lower classes belong to the predicted top class; the leaf repeats its name."""
    return _unique(rows, "vec_id") and all(r["low_pred"] == "2" if r["top_pred"] == "2" else int(r["low_pred"]) % 3 == int(r["top_pred"]) for r in rows)


def _levels(rows) -> bool:
    return _unique(rows, "vec_id") and all(r["top_pred"] in "012" and 0 <= int(r["low_pred"]) for r in rows)


def _bake_off(rows) -> bool:
    return sorted(r["model"] for r in rows) == ["GBT", "KNN", "LDA", "RF"] and all(0 <= r["accuracy"] <= 1 and -1 <= r["mcc"] <= 1 for r in rows)


def _grid(rows) -> bool:
    return sum(r["best"] for r in rows) == 1 and max(rows, key=lambda r: r["mcc"])["mcc"] == next(r["mcc"] for r in rows if r["best"])


def _stored(rows) -> bool:
    leaf = all(r["main"] == r["sub"] == "2" and r["sub_prob"] is None for r in rows if r["parent"] == "2")
    own = all(int(r["sub"]) % 3 == int(r["parent"]) and r["main"] == f"main {int(r['sub']) % 2}" for r in rows if r["parent"] != "2")
    gate = all(r["confident"] == (r["parent_prob"] > 0.8 and (r["sub_prob"] is None or r["sub_prob"] > 0.8)) for r in rows)
    return _unique(rows, "vec_id") and leaf and own and gate


def _places(rows) -> bool:
    return _unique(rows, "id", "place") and all(r["percent"] is None or r["percent"] <= 100 + 1e-9 for r in rows)


def _composition(rows) -> bool:
    """Shares are negative only where the others print more than 100 together; later steps leave such products out."""
    others, negative = defaultdict(float), set()
    for r in rows:
        if "." not in r["place"]:
            others[r["id"]] += max(r["percent"] or 0, 0)
            negative |= {r["id"]} if (r["percent"] or 0) < 0 else set()
    return _places(rows) and all(others[i] > 100 for i in negative)


def _sums(rows) -> bool:
    """Shares add up to the total that is told, which is 100 where the list converged."""
    total, told = defaultdict(float), {}
    for r in rows:
        total[r["id"]] += r["percent"] or 0
        told[r["id"]] = (r["tot_percent"], r["converged"])
    return _unique(rows, "id", "pos") and all(abs(total[i] - t) < 0.01 and (abs(t - 100) < 0.5) == c for i, (t, c) in told.items())


def _hidden(rows) -> bool:
    """Every trial of a list of n hides k of its places."""
    return all(2 <= r["k"] <= r["n"] and r["hidden"] % r["k"] == 0 and (r["mean_error"] is None or r["mean_error"] >= 0) and 0 <= r["converged"] <= 1 for r in rows)


def _both_databases(rows) -> bool:
    return {r["database"] for r in rows} == {"open", "shop"} and all((r["product_id"] % 2 == 1) == (r["database"] == "open") for r in rows)


def _components(rows) -> bool:
    return _unique(rows, "vec_id") and len({r["k"] for r in rows}) == 1 and 0 < rows[0]["k"] <= 64


def _same_supply(rows) -> bool:
    """The series and the direct solution agree, and no production ends nowhere."""
    close = all(abs((r["supply"] or 0) - (r["direct"] or 0)) <= 1e-5 * max(1, r["direct"] or 0) for r in rows)
    return _unique(rows, "item", "yr", "origin", "consumer") and close and all((r["residual"] or 0) < 1e-9 for r in rows)


def _draws(rows) -> bool:
    """All repetitions (seafood: half of them) of every ingredient, on more than one observation where there are any."""
    return _unique(rows, "product", "food_category", "food_category_sub", "food_category_sub_sub", "organic", "pool") and all(
        r["draws"] in (1500, 3000) and 1 <= r["observations"] <= r["draws"] and r["least_obs"] <= r["greatest_obs"] and 0 <= r["low"] < r["high"] and (r["observations"] == 1) == (r["least_obs"] == r["greatest_obs"]) for r in rows)


def _points(rows) -> bool:
    return _unique(rows, "pool") and all(r["draws"] % 1500 == 0 and 0 <= r["low"] < r["high"] for r in rows)


def _ordered(*names):
    """Per product: the named statistics in rising order, for each thing that they are told of."""

    def law(rows) -> bool:
        things = [c.removeprefix(f"{names[0]}_") for c in rows[0].asDict() if c.startswith(f"{names[0]}_")]
        up = all(r[f"{a}_{t}"] <= r[f"{b}_{t}"] + 1e-4 for r in rows for t in things for a, b in zip(names, names[1:], strict=False))
        return bool(things) and _unique(rows, "product") and up and any(r[f"{names[0]}_{t}"] < r[f"{names[-1]}_{t}"] for r in rows for t in things)

    return law


def _ranks(rows) -> bool:
    """Whole repetitions by one score: the means of the scored indicators rise from the least to the greatest rank."""
    names, scored = ["min", "lower_fifth", "fifty", "upper_ninetyfifth", "max"], ["ghg", "eut", "watscar", "land"]
    mean = lambda n, i: sum(r[f"{n}_{i}"] for r in rows)
    return _unique(rows, "product") and all(sum(mean(a, i) for i in scored) < sum(mean(b, i) for i in scored) for a, b in zip(names, names[1:], strict=False))


def _shares(rows) -> bool:
    sums = defaultdict(float)
    for r in rows:
        sums[r["product"]] += r["ghg"]
    return _unique(rows, "product", "food_category") and all(abs(s - 1) < 1e-4 for s in sums.values()) and any(r["ghg"] < 0.9 for r in rows)


LAWS = {
    "cls01_forest": _is_class("top", "pred"), "cls02_network": _is_class("top", "pred"), "cls03_hierarchical": _hierarchy,
    "cls05_discriminant": _is_class("low", "pred"), "cls06_per_level": _levels, "cls07_bake_off": _bake_off, "cls08_grid_search": _grid,
    "cls16_stored_models": _stored,
    "cmp01_composition": _composition, "cmp09_sum_to_100": _sums, "cmp10_embedded": _places, "cmp11_hidden_check": _hidden,
    "ing02_product_table": _both_databases, "sta08_pca": _components, "trd08_re_export_series": _same_supply,
    "mc02_weighted_draws": _draws, "jon13_draw_points": _points, "mc05_product_totals": _ordered("least", "mean", "most"), "mc06_composite": _ordered("least", "mean", "most"),
    "mc07_statistics": _ordered("lower_ci", "mean", "upper_ci"), "win05_rank_rows": _ranks, "mc08_contributions": _shares,
}
