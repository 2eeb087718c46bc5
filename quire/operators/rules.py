"""Ruled tables of many pages at once, in numpy and pandas: the pages of a batch are cut into parts of a bounded number of pairs.

Everything is told by a page's number in its part (pg), and a group of rules by a number of its own (g). What meets within a page or group is looked
for in pieces of at most PAIRS pairs, so a page with very many rules takes time but no more memory than what it finds.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd

#: Rounded edges that are no further from the one before than this are one.
NEAR = 3
PAIRS = 2_000_000
SIDES = ["x0", "y0", "x1", "y1"]


def meet(a: np.ndarray, b: np.ndarray, test) -> tuple[np.ndarray, np.ndarray]:
    """Places (i, j) of equal keys a[i] = b[j] where test(i, j) holds; in order of i and j if b is sorted."""
    order = np.argsort(b, kind="stable")
    low, high = (np.searchsorted(b[order], a, s) for s in ("left", "right"))
    upto = np.cumsum(high - low)
    some, at = [], 0
    while at < len(a):
        end = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + PAIRS, "right")))
        n = (high - low)[at:end]
        for i, j in _paired(np.arange(at, end), low[at:end], n):
            j = order[j]
            ok = test(i, j)
            some.append((i[ok], j[ok]))
        at = end
    none = np.zeros(0, np.int64)
    return tuple(np.concatenate([s[k] for s in some]) if some else none for k in (0, 1))


def _paired(i: np.ndarray, low: np.ndarray, n: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Each of i with its n places from low on; a single one with very many comes in pieces."""
    if len(i) == 1:
        for k in range(int(low[0]), int(low[0] + n[0]), PAIRS):
            j = np.arange(k, min(k + PAIRS, int(low[0] + n[0])))
            yield np.full(len(j), i[0]), j
    else:
        yield np.repeat(i, n), np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + np.repeat(low, n)


def half_up(v: pd.Series | np.ndarray) -> np.ndarray:
    return np.floor(np.asarray(v, float) + 0.5).astype(np.int64)


def middles(g: np.ndarray, v: np.ndarray, k: np.ndarray) -> pd.Series:
    """The median of each group's values, each of which counts k times; by group."""
    known = ~np.isnan(v)
    d = pd.DataFrame({"g": g[known], "v": v[known], "k": k[known]}).groupby(["g", "v"], as_index=False)["k"].sum()  # sorted
    upto = d["k"].cumsum().to_numpy()
    n = d.groupby("g")["k"].sum()
    before = n.cumsum().to_numpy() - n.to_numpy()
    pick = lambda place: d["v"].to_numpy()[np.searchsorted(upto, before + place, "right")]
    low, high = pick((n.to_numpy() - 1) // 2), pick(n.to_numpy() // 2)
    return pd.Series(np.where(low == high, low, 0.5 * low + 0.5 * high), n.index)


def chained(keys: dict[str, np.ndarray], v: np.ndarray) -> pd.DataFrame:
    """(keys, v): the distinct values of each key that are more than NEAR above the one before, or the first; sorted."""
    names = list(keys)
    d = pd.DataFrame({**keys, "v": v}).drop_duplicates().sort_values([*names, "v"], ignore_index=True)
    step = d.groupby(names)["v"].diff()
    return d[step.isna() | (step > NEAR)].reset_index(drop=True)


def _numbered(d: pd.DataFrame, keys: list[str], number: str) -> pd.DataFrame:
    by = d.groupby(keys)
    d = d.assign(**{number: by.cumcount(), "next": by["v"].shift(-1)})
    d = d[d["next"].notna()]
    return d.assign(next=d["next"].astype(np.int64)).reset_index(drop=True)


def backgrounds(paths: pd.DataFrame, ink: pd.DataFrame) -> pd.DataFrame:
    """paths with kind: box, highlight, or null: as tables.line_backgrounds."""
    a = {c: paths[c].to_numpy() for c in SIDES}
    cx, cy = ink["cx"].to_numpy(), ink["cy"].to_numpy()
    those = np.flatnonzero(((paths["w"] > 8) & (paths["h"] > 3)).to_numpy())
    i, j = meet(paths["pg"].to_numpy()[those], ink["pg"].to_numpy(), lambda i, j: (cx[j] > a["x0"][those[i]]) & (cx[j] < a["x1"][those[i]]) & (cy[j] > a["y0"][those[i]]) & (cy[j] < a["y1"][those[i]]))
    i = those[i]
    held = pd.DataFrame({"i": i, "k": ink["k"].to_numpy()[j], "oy": ink["oy"].to_numpy()[j]}).groupby("i").agg(n=("k", "sum"), top=("oy", "min"), bottom=("oy", "max"))
    held["size"] = middles(i, ink["size"].to_numpy()[j], ink["k"].to_numpy()[j])
    d = paths.join(held)
    one = (d["h"] <= d["size"] * 2) & (d["bottom"] - d["top"] < d["size"] * 0.5)
    box = d["outline"] & ~d["filled"] & (d["w"] > d["size"] * 4) & (d["n"] >= 2)
    return paths.assign(kind=np.where(one, np.where(box, "box", "highlight"), None))


def segments(paths: pd.DataFrame, page: pd.DataFrame) -> pd.DataFrame:
    """The segments of paths that are no backgrounds: (pg, seg, upright, at, low, high, seen, shape, x0..y1, b_x0..b_y1), sorted by pg and seg. seen: whether its
    edge has a colour, and isn't on a ground of the same colour."""
    use = paths[paths["kind"].isna()]
    w, h = use["w"], use["h"]
    size = page.loc[use["pg"]]
    up, level = (w <= 3) & (h >= 8), (h <= 3) & (w >= 8)
    sided = ~up & ~level & (w > 8) & (h > 8) & (w < size["page_w"].to_numpy() * 0.95) & (h < size["page_h"].to_numpy() * 0.95)
    parts = []
    for those, k, upright, at, low, high, shape in (
        (up, 0, True, (use["x0"] + use["x1"]) / 2, "y0", "y1", False), (~up & level, 0, False, (use["y0"] + use["y1"]) / 2, "x0", "x1", False),
        (sided, 0, True, use["x0"], "y0", "y1", True), (sided, 1, True, use["x1"], "y0", "y1", True), (sided, 2, False, use["y0"], "x0", "x1", True), (sided, 3, False, use["y1"], "x0", "x1", True),
    ):
        of = use[those]
        parts.append(of[["pg", *SIDES, "seen", "c0", "c1", "c2"]].assign(seg=of["path_id"] * 4 + k, upright=upright, at=at[those], low=of[low], high=of[high], shape=shape))
    s = pd.concat(parts).sort_values(["pg", "seg"], ignore_index=True)
    ground = paths[~paths["stroked"] & paths["filled"] & (paths["w"] > 8) & (paths["h"] > 8)]
    lines = np.flatnonzero((~s["shape"] & s["seen"]).to_numpy())
    l, f = s.iloc[lines], {c: ground[c].to_numpy() for c in (*SIDES, "f0", "f1", "f2")}
    e = {"x0": np.where(l["upright"], l["at"], l["low"]), "x1": np.where(l["upright"], l["at"], l["high"]), "y0": np.where(l["upright"], l["low"], l["at"]), "y1": np.where(l["upright"], l["high"], l["at"])}
    c = [l[f"c{k}"].to_numpy() for k in range(3)]

    def unseen(i, j):
        on = (f["x0"][j] - 2 <= e["x0"][i]) & (f["x1"][j] + 2 >= e["x1"][i]) & (f["y0"][j] - 2 <= e["y0"][i]) & (f["y1"][j] + 2 >= e["y1"][i])
        return on & (sum(np.abs(c[k][i] - f[f"f{k}"][j]) for k in range(3)) <= 12)

    i, _ = meet(l["pg"].to_numpy(), ground["pg"].to_numpy(), unseen)
    seen = s["seen"].to_numpy().copy()
    seen[lines[i]] = False
    u = s["upright"]
    reach = {"b_x0": np.where(u, s["at"], s["low"]) - 1, "b_x1": np.where(u, s["at"], s["high"]) + 1, "b_y0": np.where(u, s["low"], s["at"]) - 1, "b_y1": np.where(u, s["high"], s["at"]) + 1}
    return s.drop(columns=["c0", "c1", "c2"]).assign(seen=seen, **reach)


def groups(s: pd.DataFrame) -> pd.DataFrame:
    """Segments with g, the place of the smallest one that they touch, to within 2 points, over any number of others, and table_id, its name."""
    x0, y0, x1, y1 = (s["b_" + c].to_numpy() for c in SIDES)
    a, b = meet(s["pg"].to_numpy(), s["pg"].to_numpy(), lambda i, j: (j < i) & (x0[i] <= x1[j] + 2) & (x0[j] <= x1[i] + 2) & (y0[i] <= y1[j] + 2) & (y0[j] <= y1[i] + 2))
    label = np.arange(len(s))
    while True:
        now = label.copy()
        # what a segment hangs on takes the smaller one's label, too, so long chains need few rounds
        for p, q in ((a, b), (b, a)):
            np.minimum.at(now, p, label[q])
            np.minimum.at(now, label[p], label[q])
        now = now[now]
        if (now == label).all():
            return s.assign(g=label, table_id=s["seg"].to_numpy()[label])
        label = now


def cells(s: pd.DataFrame, t: pd.DataFrame) -> pd.DataFrame:
    """(g, row, col, x0, y0, x1, y1): the cells between rules of each table t (g, x0..y1): rows from one rule to the next, and in
    each of them cells from one upright segment to the next of those that pass through it."""
    mine = s[s["g"].isin(t["g"])]
    level, ups = mine[~mine["upright"]], mine[mine["upright"]]
    ends = lambda low, high: np.concatenate([half_up(t[low] + 1), half_up(t[high] - 1)])
    both = np.concatenate([t["g"], t["g"]])
    ys = chained({"g": np.concatenate([level["g"], both])}, np.concatenate([half_up(level["at"]), ends("y0", "y1")]))
    rows = _numbered(ys, ["g"], "row").rename(columns={"v": "y0", "next": "y1"})
    columns = chained({"g": ups["g"].to_numpy()}, half_up(ups["at"]))
    mid, low, high, at = (rows["y0"].to_numpy() + rows["y1"].to_numpy()) / 2, ups["low"].to_numpy(), ups["high"].to_numpy(), ups["at"].to_numpy()
    i, j = meet(rows["g"].to_numpy(), ups["g"].to_numpy(), lambda i, j: (low[j] <= mid[i] + 1) & (high[j] >= mid[i] - 1))
    v = columns["v"].to_numpy()
    k, c = meet(rows["g"].to_numpy()[i], columns["g"].to_numpy(), lambda k, c: np.abs(at[j[k]] - v[c]) < 3)
    passing = rows.iloc[i[k]][["g", "row"]].assign(v=v[c])
    by_table = t.set_index("g").loc[rows["g"]]
    edges = [rows[["g", "row"]].assign(v=half_up(x)) for x in (by_table["x0"] + 1, by_table["x1"] - 1)]
    cuts = pd.concat([passing, *edges])
    out = _numbered(chained({"g": cuts["g"].to_numpy(), "row": cuts["row"].to_numpy()}, cuts["v"].to_numpy()), ["g", "row"], "col").rename(columns={"v": "x0", "next": "x1"})
    return out.merge(rows, on=["g", "row"])


def ruled(s: pd.DataFrame, ink: pd.DataFrame, page: pd.DataFrame) -> tuple[pd.DataFrame, pd.DataFrame, pd.DataFrame]:
    """(tables, segments, cells): groups that are tables (pg, g, x0..y1), what they are made of, and their cells.

    Two columns and more make a table if there are four characters inside, and not many beside it. One column does with three
    rules right across, the first row like a title, or with four; and a closed box around text that is lower than 0.4 of the page.
    Where a drawn box of one column has unseen shapes touching it from outside, these are left out first.
    """
    seen = s[s["seen"]]
    up = seen[seen["upright"]]
    two = chained({"g": up["g"].to_numpy()}, half_up(up["at"])).groupby("g").size()
    extent = seen.groupby("g").agg(e_x0=("b_x0", "min"), e_y0=("b_y0", "min"), e_x1=("b_x1", "max"), e_y1=("b_y1", "max"))
    e = extent.loc[two[two == 2].index].reindex(s["g"]).set_axis(s.index)
    outside = (s["y1"] <= e["e_y0"] + 3) | (s["y0"] >= e["e_y1"] - 3) | (s["x1"] <= e["e_x0"] + 3) | (s["x0"] >= e["e_x1"] - 3)
    s = s[~(~s["seen"] & s["shape"] & outside)].reset_index(drop=True)

    ups = s[s["upright"]]
    box = s.groupby("g").agg(pg=("pg", "first"), x0=("b_x0", "min"), y0=("b_y0", "min"), x1=("b_x1", "max"), y1=("b_y1", "max"), n=("shape", "size"), shapes=("shape", "sum"))
    columns = chained({"g": ups["g"].to_numpy()}, half_up(ups["at"]))
    level = s[~s["upright"]]
    wide = (box["x1"] - box["x0"]).loc[level["g"]].to_numpy()
    level = level[(level["high"] - level["low"]).to_numpy() >= wide * 0.9]
    rules = chained({"g": level["g"].to_numpy()}, half_up(level["at"]))
    place = rules.groupby("g").cumcount()
    first, second = (rules[place == k].set_index("g")["v"] for k in (0, 1))
    # of each outer edge of a group: whether one segment is nearly as high as the group, and whether one is seen
    at, v = ups["at"].to_numpy(), columns["v"].to_numpy()
    i, j = meet(columns["g"].to_numpy(), ups["g"].to_numpy(), lambda i, j: np.abs(at[j] - v[i]) <= 3)
    tall = (box["y1"] - box["y0"]).loc[ups["g"]].to_numpy()
    whole = ((ups["high"] - ups["low"]).to_numpy() >= tall * 0.9)[j]
    flags = columns.assign(closed=False, drawn=False)
    for name, ok in (("closed", whole), ("drawn", ups["seen"].to_numpy()[j])):
        held = np.zeros(len(columns), bool)
        held[i[ok]] = True
        flags[name] = held
    sides = flags.groupby("g").agg(n_x=("v", "size"), closed=("closed", "all"), drawn=("drawn", "all"))

    b, cx, cy = {c: box[c].to_numpy() for c in SIDES}, ink["cx"].to_numpy(), ink["cy"].to_numpy()
    i, j = meet(box["pg"].to_numpy(), ink["pg"].to_numpy(), lambda i, j: (cy[j] > b["y0"][i]) & (cy[j] < b["y1"][i]))
    near = pd.DataFrame({"g": box.index.to_numpy()[i], "cx": cx[j], "cy": cy[j], "oy": ink["oy"].to_numpy()[j], "size": ink["size"].to_numpy()[j], "k": ink["k"].to_numpy()[j]})
    near["in"] = (cx[j] > b["x0"][i]) & (cx[j] < b["x1"][i])
    out = (cx[j] < b["x0"][i] - 2) | (cx[j] > b["x1"][i] + 2)
    close = (cx[j] > b["x0"][i] - 40) & (cx[j] < b["x1"][i] + 40)
    counts = pd.DataFrame({"g": near["g"], "n": near["k"] * near["in"], "beside": near["k"] * out, "spill": near["k"] * (out & close)}).groupby("g").sum()
    inner = near[near["in"]]
    counts["size"] = middles(inner["g"].to_numpy(), inner["size"].to_numpy(), inner["k"].to_numpy())
    heights = inner.groupby("g")["oy"]
    counts["spread"] = heights.max() - heights.min()
    lines = inner[["g", "oy"]].drop_duplicates().sort_values(["g", "oy"])
    step = lines.groupby("g")["oy"].diff()
    lines = lines[step.isna() | (step.to_numpy() > counts["size"].loc[lines["g"]].to_numpy() * 0.6)].groupby("g").size()

    d = box.drop(columns=["n"]).assign(shaped=box["shapes"] >= box["n"] * 0.8).join(sides, how="inner").join(counts)
    d["rules"], d["lines"] = rules.groupby("g").size().reindex(d.index).fillna(0), lines.reindex(d.index).fillna(0)
    d = d[ups.groupby("pg").size().reindex(d["pg"]).fillna(0).to_numpy() >= 3]
    size, n = d["size"].fillna(0), d["n"].fillna(0)
    titled = (d["rules"] >= 3) & (size > 0) & ((second.reindex(d.index) - first.reindex(d.index)) <= size * 3)
    height = page["page_h"].loc[d["pg"]].to_numpy()
    note = d["closed"] & (d["rules"] == 2) & (d["lines"] >= 1) & (d["y1"] - d["y0"] < height * 0.4) & (d["x1"] - d["x0"] > size * np.where(d["lines"] >= 2, 8, 4)) & d["drawn"]
    single = (d["n_x"] == 2) & ((d["rules"] >= 4) | titled | note) & (d["beside"].fillna(0) <= n * 0.2)
    found = d[((d["n_x"] >= 3) | single) & (n >= np.where(d["n_x"] < 3, 2, 4)) & (d["spill"].fillna(0) <= n * 0.1)]
    found = found.assign(one_line=found["spread"] < found["size"].fillna(0) * 0.6).reset_index()

    ce = cells(s, found)
    c, q = {k: ce[k].to_numpy() for k in SIDES}, {k: near[k].to_numpy() for k in ("cx", "cy")}
    near = near[near["g"].isin(found["g"])]
    q = {k: near[k].to_numpy() for k in ("cx", "cy")}
    i, _ = meet(ce["g"].to_numpy(), near["g"].to_numpy(), lambda i, j: (q["cy"][j] >= c["y0"][i]) & (q["cy"][j] < c["y1"][i]) & (q["cx"][j] >= c["x0"][i]) & (q["cx"][j] < c["x1"][i]))
    filled = ce.iloc[np.unique(i)].groupby("g").size().reindex(found["g"]).fillna(0).to_numpy()
    made = ce.groupby("g").size().reindex(found["g"]).fillna(0).to_numpy()
    # shapes drawn around one line of text are no table
    frame = found["shaped"] & (found["n_x"] >= 3) & (filled <= 1) & found["one_line"] & (made >= 2)
    kept = found[~frame & (made > 0)]
    return kept[["pg", "g", *SIDES]], s, ce[ce["g"].isin(kept["g"])].reset_index(drop=True)


def spanned(ce: pd.DataFrame, s: pd.DataFrame) -> pd.DataFrame:
    """(g, row, col, x0, y0, x1, y1, colspan, rowspan): cells that take up several columns and rows.

    A table's columns begin where any cell's sides stand, sides NEAR each other being one, the first in reading order. A cell goes on in the row below if that has one of
    the same columns and no rule passes between them in the middle.
    """
    ce = ce.sort_values(["g", "row", "col"], ignore_index=True)
    sides = pd.DataFrame({"g": np.repeat(ce["g"].to_numpy(), 2), "v": ce[["x0", "x1"]].to_numpy().ravel()}).drop_duplicates()
    edges: list[tuple[int, int]] = []
    some: list[int] = []
    last = None
    for g, v in zip(sides["g"].tolist(), sides["v"].tolist()):
        if g != last:
            edges += [(last, x) for x in sorted(some)]
            some, last = [], g
        if all(abs(v - x) > NEAR for x in some):
            some.append(v)
    edges = np.array(edges + [(last, x) for x in sorted(some)], np.int64).reshape(-1, 2) if last is not None else np.zeros((0, 2), np.int64)
    start = np.searchsorted(edges[:, 0], ce["g"].to_numpy())
    placed = {}
    for name, c in (("a", "x0"), ("z", "x1")):
        x = ce[c].to_numpy()
        i, j = meet(ce["g"].to_numpy(), edges[:, 0], lambda i, j, x=x: np.abs(edges[j, 1] - x[i]) <= NEAR)
        at = np.full(len(ce), len(edges))
        np.minimum.at(at, i, j)
        placed[name] = at - start
    level = s[~s["upright"]]
    mid, y0 = (ce["x0"].to_numpy() + ce["x1"].to_numpy()) / 2, ce["y0"].to_numpy()
    h = {c: level[c].to_numpy() for c in ("at", "low", "high")}
    i, _ = meet(ce["g"].to_numpy(), level["g"].to_numpy(), lambda i, j: (np.abs(h["at"][j] - y0[i]) <= 2.5) & (h["low"][j] <= mid[i] + 1) & (h["high"][j] >= mid[i] - 1))
    parted = np.zeros(len(ce), bool)
    parted[i] = True
    ce = ce.assign(**placed, parted=parted).sort_values(["g", "a", "z", "row"], kind="stable", ignore_index=True)
    new = ~((ce.groupby(["g", "a", "z"])["row"].shift() == ce["row"] - 1) & ~ce["parted"])
    out = ce.groupby(new.cumsum().to_numpy()).agg(g=("g", "first"), row=("row", "first"), col=("col", "first"), x0=("x0", "first"), y0=("y0", "min"), x1=("x1", "first"), y1=("y1", "max"), a=("a", "first"), z=("z", "first"), rowspan=("row", "size"))
    return out.assign(colspan=np.maximum(1, out["z"] - out["a"]))


def one_cells(paths: pd.DataFrame, tables: pd.DataFrame, ink: pd.DataFrame) -> pd.DataFrame:
    """(pg, path_id, is_table): boxes around one line: tables of one cell, unless they meet a ruled table or text stands beside them."""
    box = paths[paths["kind"] == "box"]
    b, t, cx, cy = {c: box[c].to_numpy() for c in SIDES}, {c: tables[c].to_numpy() for c in SIDES}, ink["cx"].to_numpy(), ink["cy"].to_numpy()
    met, _ = meet(box["pg"].to_numpy(), tables["pg"].to_numpy(), lambda i, j: (t["x0"][j] < b["x1"][i]) & (b["x0"][i] < t["x1"][j]) & (t["y0"][j] < b["y1"][i]) & (b["y0"][i] < t["y1"][j]))
    beside, _ = meet(box["pg"].to_numpy(), ink["pg"].to_numpy(), lambda i, j: (cy[j] > b["y0"][i]) & (cy[j] < b["y1"][i]) & ((cx[j] < b["x0"][i] - 2) | (cx[j] > b["x1"][i] + 2)))
    yes = np.ones(len(box), bool)
    yes[met], yes[beside] = False, False
    return box[["pg", "path_id"]].assign(is_table=yes)
