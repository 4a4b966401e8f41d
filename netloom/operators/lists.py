"""Columns over the lists of small pictures, a row each, in numpy batches: points on common lines, merged points, groups of
ports. Rows are shuffled by picture once, and nothing is joined for single points."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from netloom.operators.graph import flat, least_labels, lists_like

PAIRS = 4_000_000  # pairs of points that are looked at together
LONGS = T.ArrayType(T.LongType())


def gathered(df: DataFrame, name: str, *more: Column, ordered: bool = False) -> DataFrame:
    """(image_id, name, *more): the other columns of the rows of a picture as a list of structs; `more` are aggregates."""
    rows = F.collect_list(F.struct(*[c for c in df.columns if c != "image_id"]))
    return df.where("image_id is not null").groupBy("image_id").agg((F.sort_array(rows) if ordered else rows).alias(name), *more)


def _limits(tol: pa.Array) -> np.ndarray:
    """One limit for each list; nothing lies within a missing one."""
    return tol.cast(pa.float64()).to_numpy(zero_copy_only=False)


def _codes(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(code of each entry, first entry of each code): equal keys have equal codes, which rise with the keys in order."""
    order = np.lexsort(keys[::-1])
    new = np.ones(len(order), bool)
    new[1:] = np.any([np.diff(k[order]) != 0 for k in keys], axis=0)
    code = np.empty(len(order), np.int64)
    code[order] = np.cumsum(new) - 1
    return code, order[new]


# ---- points ------------------------------------------------------------------------------------------
def _snapped(lists: pa.Array, tol: pa.Array) -> pa.Array:
    (row, v), limit = flat(lists), _limits(tol)
    code, first = _codes(row, v)
    row, v = row[first], v[first]
    new = np.ones(len(v), bool)
    new[1:] = (np.diff(row) != 0) | (np.diff(v) > limit[row[1:]])
    start = np.flatnonzero(new)
    n = np.diff(np.append(start, len(v)))
    mid = np.trunc(v[start + (n - 1) // 2] * 0.5 + v[start + n // 2] * 0.5).astype(np.int64)
    return lists_like(lists, mid[np.cumsum(new) - 1][code])


def snapped(values: Column, tol: Column) -> Column:
    """Each value of a list moved to the truncated median of its cluster of distinct values, as `wiring.snap_axis`."""
    return F.arrow_udf(_snapped, LONGS)(values, tol)


def _pairs(row: np.ndarray, most: int):
    """(u, v), u < v: all pairs of entries of one list, in blocks."""
    after = np.searchsorted(row, row, "right") - np.arange(len(row)) - 1
    done, sums = 0, np.cumsum(after)
    while done < len(row):
        till = max(done + 1, int(np.searchsorted(sums, (sums[done - 1] if done else 0) + most, "right")))
        n = after[done:till]
        u = np.repeat(np.arange(done, till), n)
        yield u, u + 1 + np.arange(len(u)) - np.repeat(np.cumsum(n) - n, n)
        done = till


def merged(x: Column, y: Column, tol: Column, round_metric: bool = True) -> Column:
    """(x, y) lists of the truncated mean of all points of the list that are joined by steps of at most `tol`, as
    `wiring.merge_points`."""
    most = PAIRS

    def means(x: pa.Array, y: pa.Array, tol: pa.Array) -> pa.Array:
        (row, u), v, limit = flat(x), flat(y)[1], _limits(tol)
        code, first = _codes(row, u, v)
        own, px, py = row[first], u[first], v[first]
        ends = [np.zeros((2, 0), np.int64)]
        for a, b in _pairs(own, most):
            dx, dy = px[a] - px[b], py[a] - py[b]
            d = np.sqrt((dx * dx + dy * dy).astype(np.float64)) if round_metric else np.maximum(np.abs(dx), np.abs(dy))
            near = d <= limit[own[a]]
            ends.append(np.stack([a[near], b[near]]))
        label = least_labels(len(own), *np.concatenate(ends, axis=1))[code]
        n = np.bincount(label, minlength=len(own))

        def mean(of):
            total = np.zeros(len(own), np.int64)
            np.add.at(total, label, of)
            return lists_like(x, (total[label] / n[label]).astype(np.int64))
        return pa.StructArray.from_arrays([mean(u), mean(v)], names=["x", "y"])

    return F.arrow_udf(means, T.StructType([T.StructField("x", LONGS), T.StructField("y", LONGS)]))(x, y, tol)


# ---- groups ------------------------------------------------------------------------------------------
PLACE = 0xFFFFFFFF  # the half of a port's id that tells it from others of its component


def grouped(ports: Column, links: Column, ties: Column, final: bool = False, several: bool = False) -> Column:
    """The group of each of `ports`, as `wiring.port_groups`: ports(id, px, py), links(ord, id, jx, jy) in order,
    ties(ax, ay, bx, by). With `several` null for groups of one component only, as `wiring.eligible`."""
    def groups(ports: pa.Array, px: pa.Array, py: pa.Array, linked: pa.Array, jx: pa.Array, jy: pa.Array,
               ax: pa.Array, ay: pa.Array, bx: pa.Array, by: pa.Array) -> pa.Array:
        (row, node), (at, port), (on, ax) = flat(ports), flat(linked), flat(ax)
        n, k = len(node), len(port)
        ids, first = _codes(np.concatenate([row, at]), np.concatenate([node, port]))
        name, own, tied = np.concatenate([node, port])[first], ids[:n], ids[n:]
        px, py, jx, jy, ay, bx, by = (flat(c)[1] for c in (px, py, jx, jy, ay, bx, by))
        spot, spots = _codes(np.concatenate([at, on, on, row]), np.concatenate([jx, ax, bx, px]), np.concatenate([jy, ay, by, py]))
        target, a, b, here = np.split(spot, np.cumsum([k, len(on), len(on)]))
        lead = np.full(len(spots), -1)  # the port of the first link of a spot
        lead[target[::-1]] = tied[::-1]
        star = name[tied] >> 32 != name[lead[target]] >> 32 if final else np.ones(k, bool)
        both = (lead[a] >= 0) & (lead[b] >= 0)
        edges = [(lead[target][star], tied[star]), (lead[a][both], lead[b][both])]
        if not final:  # ports that are each other's target
            there, place = np.full(len(spots), -1), np.full(len(name), -1)
            np.maximum.at(there, here, own)
            place[own] = here
            back = there[target]
            known = (back >= 0) & (place[tied] >= 0)
            u, v, size = tied[known], back[known], len(spots) + 1
            held = np.isin(v * size + place[u], tied * size + target)
            edges.append((u[held], v[held]))
        label = least_labels(len(name), *(np.concatenate(e) for e in zip(*edges)))[own]
        if not several:
            return lists_like(ports, name[label])
        least, most = np.full(len(name), np.iinfo(np.int64).max), np.full(len(name), np.iinfo(np.int64).min)
        np.minimum.at(least, label, node >> 32)
        np.maximum.at(most, label, node >> 32)
        return pa.ListArray.from_arrays(lists_like(ports, node).offsets, pa.array(name[label], mask=(least == most)[label]))

    return F.arrow_udf(groups, LONGS)(*[ports[c] for c in ("id", "px", "py")], *[links[c] for c in ("id", "jx", "jy")], *[ties[c] for c in ("ax", "ay", "bx", "by")])


def _unshorted(ports: pa.Array, px: pa.Array, py: pa.Array, n_ports: pa.Array, group: pa.Array, linked: pa.Array,
               jx: pa.Array, jy: pa.Array) -> pa.Array:
    (row, node), (at, port), px, py, group, jx, jy = flat(ports), flat(linked), *(flat(c)[1] for c in (px, py, group, jx, jy))
    ids, first = _codes(np.concatenate([row, at]), np.concatenate([node, port]))
    of, tied, n = np.full(len(first), -1), ids[len(node):], len(first)
    of[ids[:len(node)]] = np.arange(len(node))
    lead = np.full(n, -1)  # the first link of a port
    lead[tied[::-1]] = np.arange(len(port))[::-1]
    two = np.zeros(n, bool)
    two[ids[:len(node)]] = flat(n_ports)[1] == 2
    p = np.flatnonzero(two & (lead >= 0))
    far = np.zeros(n)
    dx, dy = px[of[p]] - jx[lead[p]], py[of[p]] - jy[lead[p]]
    far[p] = np.sqrt((dx * dx + dy * dy).astype(np.float64))
    name, own = np.concatenate([node, port])[first], np.concatenate([row, at])[first]
    i, j = p[:-1], p[1:]  # the two ports of a component follow each other
    both = (own[i] == own[j]) & (name[j] == name[i] + 1) & (name[i] & PLACE == 0)
    i, j = i[both], j[both]
    short = group[of[i]] == group[of[j]]
    gone = np.zeros(n, bool)
    gone[np.where(far[i] > far[j], i, j)[short]] = True
    return pa.ListArray.from_arrays(lists_like(linked, port).offsets, pa.array(~gone[tied]))


def unshorted(ports: Column, groups: Column, links: Column) -> Column:
    """For each link whether `wiring.unshort` keeps it; ports(id, px, py, n_ports) with their groups, links in order."""
    return F.arrow_udf(_unshorted, T.ArrayType(T.BooleanType()))(*[ports[c] for c in ("id", "px", "py", "n_ports")], groups, *[links[c] for c in ("id", "jx", "jy")])
