"""Display filters against a plain evaluator."""

from __future__ import annotations

import random
import re

import pytest
from pyspark.sql import functions as F

from aircadence.functions.filters import display_filter
from aircadence.schema import FRAME_SCHEMA
from tests.test_frames import frames

NUMBERS = {"wlan.fc.type": "frame_type", "wlan.fc.type_subtype": "frame_subtype", "frame.len": "frame_len", "radiotap.dbm_antsignal": "rssi", "wlan.qos.priority": "qos_priority"}
ADDRESSES = {"wlan.sa": ["sa"], "wlan.da": ["da"], "wlan.bssid": ["bssid"], "wlan.addr": ["sa", "da", "ta", "ra"]}
MACS = ["aa:bb:cc:dd:ee:ff", "aa:bb:cc:00:00:01", "0a:bb:cc:dd:00:01", "b8:27:eb:01:02:03"]
PLAIN = {"==": lambda a, b: a == b, "<": lambda a, b: a < b, "<=": lambda a, b: a <= b, ">": lambda a, b: a > b, ">=": lambda a, b: a >= b}
NAMES = {"==": "eq", "<": "lt", "<=": "le", ">": "gt", ">=": "ge"}


def atom(rng):
    """A test as text and as a function of a row."""
    if rng.random() < 0.5:
        name = rng.choice(list(NUMBERS))
        column, value = NUMBERS[name], rng.choice([0, 1, 2, 8, 40, 4, 100, 1500, -45])
        there = lambda f: lambda r: r[column] is not None and f(r[column])
        kind = rng.randrange(5)
        if kind == 0 and column != "rssi":
            return f"{name} & {abs(value)}", there(lambda x: x & abs(value) != 0)
        if kind == 1:
            return f"{name} in {{{value}, 3..{value + 7}}}", there(lambda x: x == value or 3 <= x <= value + 7)
        if kind == 2:
            return name, there(lambda x: True)
        if kind == 3:
            return f"{name} {rng.choice(['!=', 'ne'])} {value if value < 0 else hex(value)}", there(lambda x: x != value)
        op = rng.choice(list(PLAIN))
        return f"{name} {rng.choice([op, NAMES[op]])} {value}", there(lambda x: PLAIN[op](x, value))
    name, mac = rng.choice(list(ADDRESSES)), rng.choice(MACS)
    some = lambda f: lambda r: any(r[c] not in (None, "") and f(r[c].lower()) for c in ADDRESSES[name])
    kind = rng.randrange(6)
    if kind == 0:
        a, n = rng.choice([(0, 3), (2, 2), (5, 1), (-2, 2)])
        return f"{name}[{a}:{n}] == {':'.join(mac.split(':')[a:][:n])}", some(lambda x: x.split(":")[a:][:n] == mac.split(":")[a:][:n])
    if kind == 1:
        part = ":".join(mac.split(":")[1:3])
        return f"{name} contains {part}", some(lambda x: f":{part}:" in f":{x}:")
    if kind == 2:
        return f'{name} matches "{mac[:2].upper()}.*0[1-3]$"', some(lambda x: re.search(f"{mac[:2]}.*0[1-3]$", x) is not None)
    if kind == 3:
        return f"{name} != {mac.upper().replace(':', '-')}", lambda r: some(lambda x: True)(r) and not some(lambda x: x == mac)(r)
    if kind == 4:
        return f"{name} in {{{mac}, {MACS[0]}}}", some(lambda x: x in (mac, MACS[0]))
    return f"{name} == {mac}", some(lambda x: x == mac)


def expression(rng, depth):
    """Text, test, and how tightly its outermost operator binds."""
    if depth == 0 or rng.random() < 0.25:
        return *atom(rng), 3
    kind = rng.randrange(3)
    inside = lambda e, least: e[0] if e[2] >= least else f"({e[0]})"
    if kind == 2:
        e = expression(rng, depth - 1)
        body = inside(e, 2)
        # A negated test without parentheses negates the whole test.
        return f"{rng.choice(['!', 'not '])}{body}", lambda r: not e[1](r), 2
    a, b = expression(rng, depth - 1), expression(rng, depth - 1)
    if kind == 0:
        return f"{inside(a, 1)} {rng.choice(['&&', 'and'])} {inside(b, 1)}", lambda r: a[1](r) and b[1](r), 1
    return f"{inside(a, 0)} {rng.choice(['||', 'OR'])} {inside(b, 0)}", lambda r: a[1](r) or b[1](r), 0


def rows_of(rng, n):
    pick = lambda *values: rng.choice(values)
    return [
        {"frame_type": pick(None, 0, 1, 2), "frame_subtype": pick(None, 0, 8, 40), "frame_len": pick(60, 100, 1500), "rssi": pick(None, -45.0, -80.0), "qos_priority": pick(None, 4, 5),
         "sa": pick(None, *MACS), "da": pick("", None, *MACS), "ta": pick(None, *MACS), "ra": pick("", *MACS), "bssid": pick(None, MACS[3].upper().replace(":", "-"))}
        for _ in range(n)
    ]


def test_expressions_equal_a_plain_evaluator(spark):
    rng = random.Random(11)
    rows = rows_of(rng, 150)
    table = frames(spark, *rows).cache()
    made = [expression(rng, 3) for _ in range(120)]
    for k in range(0, len(made), 40):
        part = made[k: k + 40]
        got = table.orderBy("frame_no").select(*(F.coalesce(display_filter(text), F.lit(False)).alias(f"f{i}") for i, (text, _, _) in enumerate(part))).collect()
        for i, (text, test, _) in enumerate(part):
            plain = [test({c: (v.replace("-", ":") if c in ("sa", "da", "ta", "ra", "bssid") and v else v) for c, v in r.items()}) for r in rows]
            assert [g[i] for g in got] == plain, text


@pytest.mark.parametrize("wrong", ["ip.src == 1", "wlan.fc.type ==", "wlan.fc.type == 2 &&", "(wlan.sa", "wlan.sa == zz", "wlan.fc.type in {1", "wlan.sa[9", "wlan.sa[x] == 1", "wlan.fc.type == 1 wlan.sa", "wlan.fc.type contains 1", "wlan.sa == aa:bb $"])
def test_what_is_not_understood_raises(wrong):
    with pytest.raises(ValueError):
        display_filter(wrong)


def test_protocols_and_the_empty_filter(spark):
    table = frames(spark, {}, {"rssi": None, "data_rate": None})
    assert [table.where(display_filter(f)).count() for f in ("", "wlan", "radiotap", "!radiotap", "wlan.fc.subtype == 8", "wlan.sa[1-2] == bb:cc && wlan.sa[5] == ff && wlan.sa[3:] == dd:ee:ff")] == [2, 2, 1, 1, 2, 2]


def test_a_filter_reaches_the_scan(spark, tmp_path):
    from aircadence.sources import pcap
    from tests.test_sources import PACKETS, pcap_bytes

    (tmp_path / "a.pcap").write_bytes(pcap_bytes(PACKETS))
    pcap.register(spark)
    rows = spark.read.format("pcap").load(str(tmp_path)).where(display_filter("wlan.fc.type == 2 && wlan.sa == B8:27:EB:01:02:03 && frame.len > 10", lower_case=True))
    pushed = next(x for x in rows._sc._jvm.PythonSQLUtils.explainString(rows._jdf.queryExecution(), "formatted").split("\n") if x.startswith("PushedFilters"))
    assert all(x in pushed for x in ("EqualTo(frame_type,2)", "EqualTo(sa,b8:27:eb:01:02:03)", "GreaterThan(frame_len,10)"))
    assert rows.count() == 2 and set(rows.columns) == set(FRAME_SCHEMA.fieldNames())
