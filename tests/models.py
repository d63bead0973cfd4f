"""Plain sequential models the operators are compared with."""

from __future__ import annotations

import random
from collections import deque

import pandas as pd

EVENT_COLUMNS = ("key string, seq bigint, kind string, saddr string, sport bigint, daddr string, dport bigint, "
                 "ltime bigint, service string, trans_depth bigint, response_body_len bigint, is_ftp_login int, "
                 "has_command int")


def random_events(seed: int, n: int = 1500, hot: float = 0.4, ftp: bool = True) -> list[dict]:
    """Timeline of several keys; the first one holds ``hot`` of all rows."""
    r = random.Random(seed)
    out = []
    for i in range(n):
        number = 0 if r.random() < hot else r.randrange(1, 25)
        kinds = ["tcp", "tcp", "conn", "http", "ftp", "ftp"] if ftp and number % 2 == seed % 2 else ["tcp", "conn", "http"]
        kind = r.choice(kinds)
        out.append({"key": f"tcp|{number}", "seq": i, "kind": kind, "saddr": "a", "sport": 1, "daddr": "b", "dport": 2,
                    "ltime": 0, "service": kind, "trans_depth": r.randrange(4), "response_body_len": r.randrange(100),
                    "is_ftp_login": r.randrange(2), "has_command": r.randrange(2)})
    return out


def events_frame(spark, events):
    return spark.createDataFrame(pd.DataFrame(events)[[c.split()[0] for c in EVENT_COLUMNS.split(", ")]], EVENT_COLUMNS)


def replay(events):
    """The live loop: one queue per side and key, http accumulator, counters."""
    state, out = {}, []
    for e in sorted(events, key=lambda x: x["seq"]):
        s = state.setdefault(e["key"], {"a": deque(), "z": deque(), "acc": None, "http": 0, "ftp": 0})

        def merge(a, z, kind, depth, length):
            http = ftp = login = 0
            if kind == "http":
                s["http"] += 1
                http = s["http"]
            else:
                depth = length = 0
            if kind == "ftp":
                s["ftp"] += z["has_command"]
                ftp, login = s["ftp"], z["is_ftp_login"]
            out.append((e["seq"], a["seq"], z["seq"], kind, depth, length, http, login, ftp))

        if e["kind"] in ("tcp", "dgram"):
            if e["kind"] == "tcp" and s["acc"]:
                length, depth, last = s["acc"]
                s["acc"] = None
                merge(e, last, "http", depth, length)
            elif s["z"]:
                z = s["z"].popleft()
                merge(e, z, z["kind"], z["trans_depth"], z["response_body_len"])
            else:
                s["a"].append(e)
        elif e["kind"] == "http":
            length, depth, _ = s["acc"] or (0, 0, None)
            s["acc"] = (length + e["response_body_len"], max(depth, e["trans_depth"]), e)
            s["z"].append(e)
        elif s["a"]:
            merge(s["a"][0] if e["kind"] == "ftp" else s["a"].popleft(), e, e["kind"], 0, 0)
        else:
            s["z"].append(e)
    return sorted(out)


def matched_set(events):
    """Set semantics: http rows fold once, early ftp rows are lost, conn rows pair in order."""
    state, out = {}, []
    for e in sorted(events, key=lambda x: x["seq"]):
        s = state.setdefault(e["key"], {"a": deque(), "z": deque(), "acc": [], "http": 0, "ftp": 0})
        if e["kind"] in ("tcp", "dgram"):
            if s["acc"]:
                s["http"] += 1
                out.append((e["seq"], e["seq"], s["acc"][-1]["seq"], "http", max(x["trans_depth"] for x in s["acc"]),
                            sum(x["response_body_len"] for x in s["acc"]), s["http"], 0, 0))
                s["acc"] = []
            elif s["z"]:
                out.append((e["seq"], e["seq"], s["z"].popleft()["seq"], "conn", 0, 0, 0, 0, 0))
            else:
                s["a"].append(e)
        elif e["kind"] == "http":
            s["acc"].append(e)
        elif e["kind"] == "ftp":
            if s["a"]:
                s["ftp"] += e["has_command"]
                out.append((e["seq"], s["a"][0]["seq"], e["seq"], "ftp", 0, 0, 0, e["is_ftp_login"], s["ftp"]))
        elif s["a"]:
            out.append((e["seq"], s["a"].popleft()["seq"], e["seq"], "conn", 0, 0, 0, 0, 0))
        else:
            s["z"].append(e)
    return sorted(out)


MERGE_VIEW = ["merge_seq", "a_seq", "z_seq", "kind", "trans_depth", "response_body_len", "ct_flw_http_mthd",
              "is_ftp_login", "ct_ftp_cmd"]


def counters(rows, same_second=True):
    """Seven counters over a deque of the last 100 rows."""
    history, out = deque(maxlen=100), []
    for r in rows:
        def same(*fields, service=False):
            n = 0
            for h in history:
                if service and h["service"] != (r["service"] or "-"):
                    continue
                if same_second and h["ltime"] != r["ltime"]:
                    continue
                n += all(h[f] == r[f] for f in fields)
            return n
        out.append((r["n"], same("saddr", service=True), same("daddr", service=True), same("daddr"), same("saddr"),
                    same("saddr", "dport"), same("daddr", "sport"), same("saddr", "daddr")))
        history.append(r)
    return out


def nearest(a, z, delta):
    """z rows in order take the smallest unused a time within delta."""
    free, out = sorted((us, seq) for seq, us in a), []
    for seq, us in z:
        for i, (t, s) in enumerate(free):
            if us - delta <= t <= us + delta:
                out.append((s, t, seq, us))
                del free[i]
                break
    return sorted(out)


def interval(a, z, tolerance):
    """Keyed arrival-order match within a tolerance."""
    waiting, out = ([], []), []
    for side, key, seq, us in sorted([(0, *x) for x in a] + [(1, *x) for x in z], key=lambda x: x[2]):
        other = waiting[1 - side]
        for i, (k, s, t) in enumerate(other):
            if k == key and abs(t - us) <= tolerance:
                del other[i]
                out.append((key, seq, us, s, t) if side == 0 else (key, s, t, seq, us))
                break
        else:
            waiting[side].append((key, seq, us))
    return sorted(out)
