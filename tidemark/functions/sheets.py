"""Sheets of derived columns: name -> expression, in ANSI SQL that any engine runs; each sheet may use the columns of those
before it. Spark adds a sheet as one projection, which Catalyst folds into its neighbours; `as_sql` nests the same sheets as text."""

from __future__ import annotations

from pyspark.sql import DataFrame

Sheet = dict[str, str]
#: What each dialect calls rounding half to even, and a regular expression's test.
SPARK = {"half_even(": "bround(", "matches(": "regexp_like("}
OTHER = {"half_even(": "round_even(", "matches(": "regexp_matches("}


def spoken(text: str, dialect: dict[str, str]) -> str:
    for ours, theirs in dialect.items():
        text = text.replace(ours, theirs)
    return text


def add(df: DataFrame, *sheets: Sheet) -> DataFrame:
    for sheet in sheets:
        df = df.selectExpr("*", *[f"{spoken(e, SPARK)} as {n}" for n, e in sheet.items()])
    return df


def in_small_methods(df: DataFrame) -> DataFrame:
    """The same rows, for many sheets. Generated methods of over 8,000 bytes are interpreted by HotSpot for ever, some six times slower; with
    the limit that Spark's documentation gives for HotSpot, such plans run as projections in small methods, which are compiled. A limit that
    the session was given is kept."""
    conf, name = df.sparkSession.conf, "spark.sql.codegen.hugeMethodLimit"
    if int(conf.get(name)) == 65_535:
        conf.set(name, "8000")
    return df


def as_sql(source: str, *sheets: Sheet) -> str:
    """source: a table's name or a query in brackets."""
    for sheet in sheets:
        source = f"(SELECT *, {', '.join(f'{spoken(e, OTHER)} AS {n}' for n, e in sheet.items())} FROM {source})"
    return source


def choose(column: str, values: dict[str, object], other: object = "NULL") -> str:
    """column's value looked up; numbers as doubles."""
    show = lambda v: f"'{v}'" if isinstance(v, str) and v != "NULL" else "NULL" if v == "NULL" else f"cast({v} as double)"
    return f"case {column} " + " ".join(f"when '{k}' then {show(v)}" for k, v in values.items()) + f" else {show(other)} end"


def steps(column: str, limits: list[tuple[str, object]], other: object) -> str:
    """The value of the first comparison (such as '<= 5') that holds."""
    show = lambda v: f"'{v}'" if isinstance(v, str) else f"cast({v} as double)"
    return "case " + " ".join(f"when {column} {c} then {show(v)}" for c, v in limits) + f" else {show(other)} end"


def present(column: str, default: float) -> str:
    """0 counts as missing, like NULL."""
    return f"coalesce(nullif({column}, 0), {default})"
