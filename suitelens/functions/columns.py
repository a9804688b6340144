"""Column expressions shared by the operators (all JVM-side built-ins)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Python's str.strip() removes whitespace at both ends; Spark's trim() only
# removes spaces. fixed values: the characters Python's str.isspace() accepts.
_PY_SPACE = (r"[\t\n\x0B\f\r\x1C-\x1F \x85\xA0\u1680\u2000-\u200A\u2028\u2029\u202F"
             r"\u205F\u3000]")
_WS_EDGES = f"^{_PY_SPACE}+|{_PY_SPACE}+$"


def col_(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def py_strip(c) -> Column:
    """Python ``str.strip()`` on a string column."""
    return F.regexp_replace(col_(c), _WS_EDGES, "")


def py_split(c) -> Column:
    """Python ``str.split()`` (no argument) on a string column: strip, then split on
    runs of whitespace; a blank string gives an empty array."""
    t = py_strip(c)
    return F.when(t == "", F.array().cast("array<string>")).otherwise(F.split(t, _PY_SPACE + "+"))


def shorten_command(c, limit: int = 60, head: int = 50, tail: int = 5) -> Column:
    """PRJ-6: shorter than ``limit`` chars -> as is, else head + marker + tail."""
    c = col_(c)
    # fixed value: the marker placed between head and tail
    marker = "...[truncated]..."
    return (F.when(F.length(c) < limit, c)
            .otherwise(F.concat(F.substring(c, 1, head), F.lit(marker),
                                F.substring(c, -tail, tail))))


def format_duration(seconds) -> Column:
    """PRJ-7: ``divmod(s, 60)`` -> ``"{int(m)}m {s:.2f}s"``.

    The remainder is exact, and it is rounded as the reference does: the exact binary value,
    ties to even. Scaled by 2**50 it is an integer plus a rest below one; a hundred times that integer still
    fits in a long, and a hundred times the rest is exact from 0.004 s on (less is 0.00), so hundredths and their rest are.
    """
    s = col_(seconds).cast("double")
    secs = F.pmod(s, F.lit(60.0))
    mins = F.round((s - secs) / 60).cast("long")
    scaled = secs * F.lit(float(1 << 50))
    whole = F.floor(scaled).cast("long")
    part = (scaled - whole.cast("double")) * 100
    times = whole * 100 + F.floor(part).cast("long")
    more = part > F.floor(part)
    cents = F.shiftright(times, 50)
    rest, half = times.bitwiseAND(F.lit((1 << 50) - 1)), F.lit(1 << 49)
    up = (rest > half) | ((rest == half) & (more | (cents % 2 == 1)))
    cents = cents + up.cast("long")
    return F.format_string("%dm %d.%02ds", mins, F.floor(cents / 100).cast("long"), cents % 100)


def run_stamp(ts) -> Column:
    """The stamp that names a run's log folder, from its start: ``20240131_235959``."""
    # fixed value: the format of the stamp
    return F.date_format(col_(ts), "yyyyMMdd_HHmmss")


def megabytes(n_bytes) -> Column:
    """Bytes as ``"{n / 1024**2:.2f} MB"``, rounded as Python does: the exact value, ties to even."""
    n = col_(n_bytes).cast("long")
    # hundredths of whole and of the remaining bytes apart, so that no product leaves a long
    whole, times = F.shiftright(n, 20), n.bitwiseAND(F.lit((1 << 20) - 1)) * 100
    cents, rest, half = F.shiftright(times, 20), times.bitwiseAND(F.lit((1 << 20) - 1)), F.lit(1 << 19)
    cents = cents + ((rest > half) | ((rest == half) & (cents % 2 == 1))).cast("long")
    return F.when(n.isNotNull(), F.format_string("%d.%02d MB", whole + F.floor(cents / 100).cast("long"), cents % 100))


def expiry_time(ts, hours, ltz: bool = False) -> Column:
    """PRJ-4: ``ts + hours`` formatted ``%Y-%m-%dT%H:%M:%SZ``.

    ``ts`` is a UTC wall-clock TIMESTAMP_NTZ; with ``ltz=True`` it is a TIMESTAMP
    (an instant), first turned into its UTC wall clock, whatever the session time zone.
    """
    h = col_(hours) if not isinstance(hours, int) else F.lit(hours)
    wall = F.convert_timezone(None, F.lit("UTC"), col_(ts).cast("timestamp_ntz")) if ltz else col_(ts)
    return F.date_format(wall + F.make_interval(hours=h.cast("int")), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def instance_name(run, task, index, hours, actor) -> Column:
    """PRJ-3: ``{run}-{task}-node{i}-timeout{h}-{actor}``."""
    return F.concat_ws("-", col_(run), col_(task), F.concat(F.lit("node"), col_(index)),
                       F.concat(F.lit("timeout"), col_(hours)), col_(actor))


def node_hostname(index, task) -> Column:
    """PRJ-3: ``node{i}-{task}``."""
    return F.concat(F.lit("node"), col_(index), F.lit("-"), col_(task))


def cluster_hostname(index) -> Column:
    """PRJ-3: ``node-{i}``."""
    return F.concat(F.lit("node-"), col_(index))


def address_name(run, task, index) -> Column:
    """PRJ-3: ``{run}_{task}_{i+1}``."""
    return F.concat_ws("_", col_(run), col_(task), (col_(index) + 1).cast("string"))


def user_data(hostname) -> Column:
    """PRJ-3: base64 of the cloud-config that sets the hostname."""
    # fixed value: cloud-config header
    return F.base64(F.encode(F.concat(F.lit("#cloud-config\nhostname: "), col_(hostname)), "UTF-8"))


def resource_tags(run, task, index, hours, actor) -> Column:
    """PRJ-3: the four-key tag map."""
    # fixed values: tag keys
    return F.create_map(
        F.lit("Name"), F.concat_ws("-", col_(run), col_(task)),
        F.lit("Index"), col_(index).cast("string"),
        F.lit("WarningHours"), col_(hours).cast("string"),
        F.lit("Actor"), col_(actor).cast("string"),
    )
