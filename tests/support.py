"""Hand-built logs and events for the engine's tests."""

from datetime import UTC, datetime

from ledgerline.operators.parse import events_of
from ledgerline.plans.project import Projections
from ledgerline.schema import PAYLOAD, Options
from ledgerline.sources.log_files import LINES, lines_of

START = 1_760_000_000_000


def stamp(ms):
    return datetime.fromtimestamp(ms / 1000, UTC).strftime("[%a %b %d %H:%M:%S %Y] ")


def log(*steps):
    """Text of a log from (seconds since the line before, message) pairs."""
    now, out = START, []
    for seconds, message in steps:
        now += seconds * 1000
        out.append(stamp(now) + message)
    return "\n".join(out) + "\n"


def files(spark, character="Owner", n=1):
    return spark.createDataFrame([(f"/logs/xlog_{character}_srv{i}.txt", i, character, f"srv{i}") for i in range(1, n + 1)], "path string, log_file_id long, character string, server string")


def parsed(spark, text, number=1, **options):
    rows = [("/logs/x.txt", number, *x) for x in lines_of(text.encode("cp1252"), **options)]
    lines = spark.createDataFrame([(p, f, no, at, size, raw, own, ts, over) for p, f, no, at, size, raw, own, ts, over in rows], LINES)
    return events_of(lines.withColumn("seq", lines["line_no"]))


def events(spark, *steps, number=1, start=START):
    """Typed events from (milliseconds since the one before, type, fields) steps."""
    rows, now = [], start
    for seq, (dt, kind, fields) in enumerate(steps, 1):
        now += dt
        value = next((fields[c] for c in ("amount", "percent_milli", "delta", "cost_points", "total_copper", "skill_value") if c in fields), None)
        rows.append((number, seq, seq * 40, seq, f"{kind} #{seq}", now, kind, "d", "r", value, *[fields.get(c) for c in PAYLOAD]))
    from ledgerline.schema import EVENT_SCHEMA

    return spark.createDataFrame(rows, EVENT_SCHEMA)


def melee(dt, attacker, target, amount):
    return dt, "melee_hit", {"attacker": attacker, "target": target, "verb": "pierce", "amount": amount, "modifiers": []}


def step(dt, kind, **fields):
    return dt, kind, fields


def projected(spark, rows, character="Owner", overrides=None, n=1, **options):
    return Projections(rows.cache(), files(spark, character, n), overrides, Options(**options))
