"""Batch features in one pass: logs are dealt by batch, and each task sums up its whole batches column-wise.

Nearly every client of a batch has a record or two, so aggregates and windows by client, pair and endpoint make as many groups as there are records. Here a task orders its records by
(batch, client, time) once; groups are stretches of that order, running values are accumulated over it, and one row a batch leaves the task. `features.client_profile` and
`features.endpoint_profile` give the same by client as Spark windows and aggregates; tests hold one against the other.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logsignals.config import EPHEMERAL, HUMAN_MEAN_MS, SLOW_DOS_PORTS
from logsignals.functions.scalar import BENIGN_SERVICE_PORTS, INJECTION, SUSPECT, injection, numeric_component, port
from logsignals.tables import enough_parts

#: Endpoints of a batch whose counts are remembered.
KEPT = 10
_PAIR = "struct<ip:string,endpoint:string,n:bigint,ep_total:bigint,lat:double,capped:bigint>"
#: A row's columns after its tenant.
COLUMNS = {
    **dict.fromkeys("batch_id total unique_ips".split(), "long"), "top_ip": "string", "top_count": "long", "lat": "double", **dict.fromkeys("top_failures failures stuffing_ips failing_ips off begin end".split(), "long"),
    "known_bad": "boolean", "streak": "long", "sequential_ips": "long", "cusum_peak": "double", "hits": "long", "families": "int", "pair": _PAIR, "slow_pair": _PAIR, "endpoints": "long", "max_entropy": "double",
    "e": "struct<ip:string,n_distinct:bigint,low_port:int,unusual:bigint,n:bigint,any_port:boolean>", "entropies": "long", "rest_mean": "double", "rest_std": "double", "periodic_ips": "long", "bot_conf": "double",
    "attacks": "long", "majority": "string", "dominant_attack": "string", "gap_list": "array<struct<rec_id:bigint,gap_ms:bigint,many:boolean>>", "rates": "array<struct<endpoint:string,n:bigint,rn:int>>", "clients": "array<struct<ip:string,n:bigint>>",
}


def batch_profile(logs: DataFrame, bad_ips: tuple[str, ...] = ()) -> DataFrame:
    """One row per batch (its tenant and COLUMNS): what `features.batch_features` reads, with its gaps, its busiest endpoints (rates) and its clients. Logs are exchanged once, by batch."""
    endpoint, status = F.col("endpoint"), F.col("status")
    kinds = sum((F.coalesce(injection(endpoint, f), F.lit(0)) * (1 << i) for i, f in enumerate(INJECTION)), F.lit(0))
    after = F.substring(endpoint, 7, 10).try_cast("int")
    plain = (after >= 0) & (endpoint == F.concat(F.lit("/port_"), after.cast("string")))  # nothing but a port: its number, which needs no pattern
    number = F.when(plain, after.cast("long")).otherwise(numeric_component(endpoint))
    told = logs.filter("batch_id IS NOT NULL").select("tenant", "batch_id", "rec_id", "sec", "ip", "endpoint", "status", "latency", "attack_category")
    read = told.repartition(enough_parts(logs), "batch_id").select(
        "tenant", F.col("batch_id").cast("long"), F.col("rec_id").cast("long"), F.col("sec").cast("long"), "ip", "endpoint", "attack_category", F.col("latency").cast("double"),
        F.coalesce(status.isin(401, 403), F.lit(False)).alias("failed"), F.coalesce(status == 200, F.lit(False)).alias("succeeded"), F.when(plain, after).otherwise(port(endpoint)).alias("place"),
        F.when(number.between(1, 10000), number).otherwise(0).cast("int").alias("v"), F.when(plain, 0).when(endpoint.rlike(SUSPECT), kinds).otherwise(0).cast("int").alias("kinds"), endpoint.startswith("/port_").alias("any_port"),
    )
    schema = {"tenant": logs.schema["tenant"].dataType.simpleString(), **COLUMNS}
    return read.mapInArrow(lambda batches: _profiles(batches, bad_ips), ", ".join(f"{c} {kind}" for c, kind in schema.items()))


def _profiles(batches: Iterator[pa.RecordBatch], bad_ips: tuple[str, ...]) -> Iterator[pa.RecordBatch]:
    """The rows of a task's batches, which it has whole: ROWS_A_TASK records or so."""
    held = [b for b in batches if b.num_rows]
    if held:
        yield _profile(pa.Table.from_batches(held), bad_ips)


def _codes(column: pa.ChunkedArray) -> tuple[np.ndarray, pa.Array]:
    """Values as numbers of a list of distinct ones; a null has one too."""
    d = column.combine_chunks().dictionary_encode("encode")
    d = d.combine_chunks() if isinstance(d, pa.ChunkedArray) else d
    return d.indices.to_numpy().astype(np.int64), d.dictionary


def _starts(*keys: np.ndarray) -> np.ndarray:
    """Where a new group begins in rows that are ordered by the keys."""
    new = np.zeros(len(keys[0]), bool)
    new[:1] = True
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    return np.flatnonzero(new)


def _sizes(start: np.ndarray, rows: int) -> np.ndarray:
    return np.diff(np.append(start, rows))


def _sum(values: np.ndarray, start: np.ndarray) -> np.ndarray:
    return np.add.reduceat(values.astype(np.float64 if values.dtype.kind == "f" else np.int64), start)


def _least_so_far(x: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Running least value within groups, by each row's place in its group: steps of doubled length."""
    step, most = 1, int(place.max(initial=0))
    while step <= most:
        x = np.where(place >= step, np.minimum(x, np.roll(x, step)), x)
        step *= 2
    return x


def _best(group: np.ndarray, groups: int, value: np.ndarray, first: np.ndarray, valid: np.ndarray | None = None) -> np.ndarray:
    """For each group the row of the largest value, of equal ones the first seen; -1 where it has none. Rows are in the order of groups."""
    rows = np.arange(len(group)) if valid is None else np.flatnonzero(valid)
    out = np.full(groups, -1)
    if len(rows):
        at = _starts(group[rows])
        rows = rows[value[rows] == np.repeat(np.maximum.reduceat(value[rows], at), _sizes(at, len(rows)))]
        rows = rows[np.lexsort((first[rows], group[rows]))]
        at = rows[_starts(group[rows])]
        out[group[at]] = at
    return out


def _lists(group: np.ndarray, groups: int, fields: dict[str, pa.Array]) -> pa.Array:
    """A list of structs for each group, from rows in the order of groups."""
    ends = np.concatenate(([0], np.cumsum(np.bincount(group, minlength=groups))))
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays(list(fields.values()), list(fields)))


def _array(values) -> pa.Array:
    return values if isinstance(values, pa.Array) else pa.array(values)


def _at(values, rows: np.ndarray) -> pa.Array:
    """values at rows, null for -1."""
    return _array(values).take(pa.array(rows, mask=rows < 0))


def _struct(rows: np.ndarray, fields: dict) -> pa.Array:
    return pa.StructArray.from_arrays([_at(v, rows) for v in fields.values()], list(fields), mask=pa.array(rows < 0))


def _half_up(x: np.ndarray) -> np.ndarray:
    return np.floor(x * 1e4 + 0.5) / 1e4


def _profile(t: pa.Table, bad_ips: tuple[str, ...]) -> pa.RecordBatch:
    raw = {c: t[c].to_numpy() for c in ("batch_id", "rec_id", "sec", "failed", "succeeded", "v", "kinds")}
    ports, no_port = t["place"].fill_null(-1).to_numpy(), t["place"].is_null().to_numpy()
    (ip, ips), (end, ends), (cat, cats) = _codes(t["ip"]), _codes(t["endpoint"]), _codes(t["attack_category"])
    ids, batch = np.unique(raw["batch_id"], return_inverse=True)
    many = len(ids)
    order = np.lexsort((raw["rec_id"], raw["sec"], ip, batch))
    rec, sec, failed, good, v = (raw[c][order] for c in ("rec_id", "sec", "failed", "succeeded", "v"))
    lat = t["latency"].fill_null(0.0).to_numpy()
    rows = len(order)

    # clients: stretches of the order
    b, i = batch[order], ip[order]
    start = _starts(b, i)
    n, first = _sizes(start, rows), np.minimum.reduceat(rec, start)
    client = np.repeat(np.arange(len(start)), n)
    place = np.arange(rows) - start[client]
    of, who = b[start], i[start]  # a client's batch and address
    groups = _starts(of)
    failures, successes, served_lat = _sum(failed, start), _sum(good, start), _sum(lat[order], start)
    fails = np.cumsum(failed)
    since = np.maximum.accumulate(np.where(good, fails, np.where(place == 0, fails - failed, 0)))
    streak = np.maximum.reduceat(fails - since, start)
    numbered = np.flatnonzero(v)
    own, value = client[numbered], v[numbered]
    begins = np.ones(len(numbered), bool)
    begins[1:] = (own[1:] != own[:-1]) | ~np.isin(np.abs(np.diff(value)), (1, 2))
    run = np.arange(len(own)) - np.maximum.accumulate(np.where(begins, np.arange(len(own)), 0)) + 1
    sequential = np.bincount(of[np.unique(own[run >= 10])], minlength=many)
    top = _best(of, many, n, first)
    bad = pc.is_in(ips, pa.array(list(bad_ips), ips.type)).to_numpy(zero_copy_only=False)
    known = np.maximum.reduceat(bad[who].astype(int), groups) > 0
    rate = successes / n
    off = _sum((sec // 3600) % 24 < 6, start)

    # gaps: all but the first record of a client
    gap = np.where(place > 0, np.diff(sec, prepend=0) * 1000, 0)
    gaps = n - 1
    mean = _sum(gap, start) / np.maximum(gaps, 1)
    std = np.sqrt(_sum(np.where(place > 0, (gap - mean[client]) ** 2, 0.0), start) / np.maximum(gaps, 1))
    some = np.flatnonzero((gaps >= 6)[client])
    p = (place[some] * HUMAN_MEAN_MS - (sec - sec[start[client]])[some] * 1000) / (std[client[some]] + 1e-6) - 0.5 * place[some]  # sum of (mean - gap) / deviation - 0.5
    peak = np.full(many, -np.inf)
    least = _least_so_far(np.where(place[some] > 0, p, 0.0), place[some])  # the first record has none: 0, as the least value is 0 at most
    np.maximum.at(peak, b[some], np.where(place[some] > 0, p - least, -np.inf))
    regular = np.flatnonzero(((n >= 10)[client]) & (place > 0))
    ordered = gap[regular][np.lexsort((gap[regular], client[regular]))]
    steady = np.flatnonzero(n >= 10)
    begin = np.cumsum(gaps[steady]) - gaps[steady]
    median = ordered[begin + (gaps[steady] - 1) // 2] / 2 + ordered[begin + gaps[steady] // 2] / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        conf = np.where(std[steady] == 0, 0.99, np.where(mean[steady] > 0, np.clip(1 - std[steady] / mean[steady], 0.0, 1.0), 0.0))
    steady, conf = steady[median >= 500], conf[median >= 500]
    bot = np.full(many, -np.inf)
    np.maximum.at(bot, of[steady], conf)
    later = np.flatnonzero(place)
    gap_list = _lists(b[later], many, {"rec_id": pa.array(rec[later]), "gap_ms": pa.array(gap[later]), "many": pa.array((gaps >= 6)[client[later]])})

    # pairs of client and endpoint, and endpoints of a batch
    row_client = np.empty(rows, np.int64)
    row_client[order] = client
    by_pair = np.argsort(row_client * len(ends) + end, kind="stable")
    at = _starts(row_client[by_pair], end[by_pair])
    p_n, p_row = _sizes(at, rows), by_pair[at]
    p_client, p_end, p_first = row_client[p_row], end[p_row], np.minimum.reduceat(raw["rec_id"][by_pair], at)
    p_batch, p_place, p_free = of[p_client], ports[p_row], no_port[p_row]
    p_lat, p_capped = _sum(lat[by_pair], at), _sum(lat[by_pair] >= 9000, at)
    by_end = np.lexsort((p_end, p_batch))
    e_at = _starts(p_batch[by_end], p_end[by_end])
    e_n, e_first, e_batch, e_end = _sum(p_n[by_end], e_at), np.minimum.reduceat(p_first[by_end], e_at), p_batch[by_end[e_at]], p_end[by_end[e_at]]
    p_total = np.empty(len(at), np.int64)
    p_total[by_end] = np.repeat(e_n, _sizes(e_at, len(at)))
    pair = lambda valid: _struct(_best(p_batch, many, p_n, p_first, valid), {"ip": ips.take(pa.array(who[p_client])), "endpoint": ends.take(pa.array(p_end)), "n": p_n, "ep_total": p_total, "lat": p_lat, "capped": p_capped})
    is_end = np.asarray(ends.is_valid())[e_end]
    busy = np.lexsort((e_first, -e_n, e_batch))
    rank = np.arange(len(busy)) - np.searchsorted(e_batch[busy], e_batch[busy])
    busy, rank = busy[rank < KEPT], rank[rank < KEPT]
    rates = _lists(e_batch[busy], many, {"endpoint": ends.take(pa.array(e_end[busy])), "n": pa.array(e_n[busy]), "rn": pa.array((rank + 1).astype(np.int32))})

    # what a client's endpoints tell: pairs are in the order of clients
    c_at = _starts(p_client)
    served = p_free | (p_place < EPHEMERAL)
    asked, distinct = _sum(np.where(served, p_n, 0), c_at), _sum(served, c_at)
    served_first = np.minimum.reduceat(np.where(served, p_first, np.iinfo(np.int64).max), c_at)
    unusual = _sum(p_free | ((p_place >= 1024) & (p_place < EPHEMERAL) & ~np.isin(p_place, BENIGN_SERVICE_PORTS)), c_at)
    low = np.maximum.reduceat((~p_free & (p_place < 1024)).astype(np.int32), c_at)
    any_port = np.maximum.reduceat(t["any_port"].combine_chunks().fill_null(False).to_numpy(zero_copy_only=False)[p_row].astype(int), c_at) > 0
    enough = asked >= 5
    entropy = np.where(enough, _half_up(np.log2(np.maximum(asked, 1)) - _sum(np.where(served, p_n * np.log2(p_n), 0.0), c_at) / np.maximum(asked, 1)), 0.0) + 0.0
    most = _best(of, many, entropy, served_first, enough)
    kinds = (raw["kinds"][p_row][:, None] >> np.arange(len(INJECTION))) & 1
    families = np.add.reduceat(kinds * p_n[:, None], c_at, axis=0)
    hits = families.sum(1)
    worst = _best(of, many, hits, first)
    rest = enough.copy()
    rest[most[most >= 0]] = False
    one = np.zeros(many)
    one[of[rest]] = entropy[rest]  # deviations are taken from one of them, so that equal ones have none
    r_n, shifted = np.bincount(of[rest], minlength=many), entropy[rest] - one[of[rest]]
    r_mean = np.bincount(of[rest], shifted, many) / np.maximum(r_n, 1)
    r_std = np.sqrt(np.bincount(of[rest], (shifted - r_mean[of[rest]]) ** 2, many) / np.maximum(r_n - 1, 1))
    e = _struct(most, {"ip": ips.take(pa.array(who)), "n_distinct": distinct, "low_port": low, "unusual": unusual, "n": n, "any_port": any_port})

    # truth
    by_cat = np.lexsort((cat, batch))
    k_at = _starts(batch[by_cat], cat[by_cat])
    k_n, k_first, k_batch, k_cat = _sizes(k_at, rows), np.minimum.reduceat(raw["rec_id"][by_cat], k_at), batch[by_cat[k_at]], cat[by_cat[k_at]]
    attack = pc.fill_null(pc.not_equal(cats, "Benign"), False).to_numpy(zero_copy_only=False)[k_cat]
    name = cats.take(pa.array(k_cat))

    null = lambda x: pa.array(x, mask=~np.isfinite(x))
    g = lambda f, x: f.reduceat(x, groups)
    columns = [
        t["tenant"].combine_chunks().take(pa.array(order[start[groups]])), ids, g(np.add, n), np.bincount(of, minlength=many), _at(ips.take(pa.array(who)), top), n[top], _sum(served_lat, groups),
        g(np.maximum, failures), g(np.add, failures), _sum((failures >= 1) & (n >= 20) & (rate >= 0.01) & (rate <= 0.08), groups), _sum((failures >= 1) & (failures / n >= 0.8) & (n >= 5), groups),
        g(np.add, off), g(np.minimum, sec[start]), g(np.maximum, sec[np.append(start[1:], rows) - 1]), known, g(np.maximum, streak), sequential, null(peak), g(np.add, hits), (families > 0).sum(1).astype(np.int32)[worst],
        pair(None), pair(~p_free & np.isin(p_place, SLOW_DOS_PORTS)), np.bincount(e_batch[is_end], minlength=many), _at(entropy, most), e, _sum(enough, groups), pa.array(one + r_mean, mask=r_n == 0), r_std,
        np.bincount(of[steady[conf > 0.85]], minlength=many), null(bot), np.bincount(k_batch, np.where(attack, k_n, 0), many).astype(np.int64), _at(name, _best(k_batch, many, k_n, k_first)), _at(name, _best(k_batch, many, k_n, k_first, attack)),
        gap_list, rates, _lists(of, many, {"ip": ips.take(pa.array(who)), "n": pa.array(n)}),
    ]
    return pa.RecordBatch.from_arrays([_array(c) for c in columns], ["tenant", *COLUMNS])
