"""From a frame to an analysis: clean, profile, roles, sweep, then KPIs, insights, outlook and questions as text.

Everything here is driver-side phrasing over profile-sized results; the data stays in Spark.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from datetime import UTC, datetime
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import compact_text as fmt
from ..functions.columns import plural, spoken, to_number
from ..operators import charts, olap, profile, retrieval
from ..operators.clean import ROW_ID, Cleaned, clean


@dataclass
class Analysis:
    name: str
    cleaned: Cleaned
    rows: int
    roles: list[olap.Role]
    measure: olap.Role | None
    dimension: olap.Role | None
    time: olap.Role | None
    frames: dict[str, DataFrame] = field(default_factory=dict)
    facts: dict = field(default_factory=dict)

    def of(self, *roles: str) -> list[olap.Role]:
        return [r for r in self.roles if r.role in roles]


def analyse(df: DataFrame, name: str = "data", plan: dict | None = None) -> Analysis:
    """`plan` may name a measure, dimension and time column; columns that do not exist are ignored."""
    cleaned = clean(df)
    data = cleaned.df.drop(ROW_ID)
    roles = olap.classify(data, cleaned.types)
    by = {r.column: r for r in roles}
    picked = lambda key, default: by.get((plan or {}).get(key, ""), default)
    a = Analysis(name, cleaned, data.count(), roles, picked("measure", olap.primary_measure(roles)), picked("dimension", olap.primary_dimension(roles)), picked("time", next((r for r in roles if r.role == "time"), None)))
    numbers = [t.column for t in cleaned.types if t.type in ("integer", "number")]
    categories = [t.column for t in cleaned.types if t.type in ("category", "boolean")]
    if numbers:
        a.frames["numeric"] = profile.describe_numeric(data, numbers)
        a.frames["outliers"] = profile.outliers(cleaned.df, [r.column for r in a.of("measure")] or numbers, ROW_ID)
    if len(numbers) > 1:
        a.frames["correlations"] = profile.correlations(data, numbers)
    if categories:
        a.frames["categories"] = profile.describe_categories(data, categories)
    a.frames["quality"] = profile.quality(data, cleaned.types)
    a.frames["nulls"] = profile.null_counts(data)
    measures, dimensions = [r.column for r in a.of("measure")], [r.column for r in a.of("dimension", "geo")]
    if measures and dimensions:
        a.frames["cube"] = olap.sweep(data, measures, dimensions)
    if a.measure and a.dimension:
        curve = olap.pareto(data, a.measure.column, a.dimension.column)
        a.frames |= {"top": olap.top_n(data, a.measure.column, a.dimension.column), "pareto": olap.pareto_summary(curve), "decomposition": olap.decompose(data, a.measure.column, a.dimension.column)}
    if a.measure and a.time:
        a.frames["periods"] = olap.period_over_period(data, a.measure.column, a.time.column)
        a.frames["series"] = olap.series_summary(a.frames["periods"])
    a.frames |= {f"chart_{k}": v for k, v in charts.bundle(cleaned.df, cleaned.types, ROW_ID).items()}
    small = ("quality", "nulls", "top", "pareto", "series", "outliers")
    a.facts = {k: [r.asDict(recursive=True) for r in a.frames[k].collect()] for k in small if k in a.frames}
    cells = sum(n["rows"] for n in a.facts["nulls"])
    a.frames["chart_radar"] = charts.quality_radar(a.frames["quality"], 100 - 100 * sum(n["nulls"] for n in a.facts["nulls"]) / cells if cells else 0.0)
    if "periods" in a.frames:
        a.facts["last_periods"] = [r.asDict() for r in a.frames["periods"].orderBy(F.desc("period")).limit(5).collect()][::-1]
    return a


def pct(v: float | None) -> str:
    return "?" if v is None else f"{v:.1f} %"


def _fact(a: Analysis, name: str) -> dict:
    """The only row of a fact, or nothing."""
    return (a.facts.get(name) or [{}])[0]


def kpis(a: Analysis) -> list[dict]:
    """Up to eight figures: label, value, trend (up, down, neutral) and a note."""
    out: list[dict] = []

    def put(label: str, value: str, note: str, rises: bool | None = None) -> None:
        out.append({"label": label, "value": value, "trend": "neutral" if rises is None else "up" if rises else "down", "sub": note})

    m, top, p, series, last = a.measure, _fact(a, "top"), _fact(a, "pareto"), _fact(a, "series"), a.facts.get("last_periods", [])
    put("Rows", f"{a.rows:,}", f"{len(a.cleaned.types)} columns, of which {len(a.of('measure'))} measure something")
    if m:
        put(f"{m.column}, all rows", fmt(m.sum), f"{m.non_null:,} rows have one", m.sum >= 0)
        put(f"{m.column}, mean row", fmt(m.mean), f"least {fmt(m.min)}, most {fmt(m.max)}", m.min is not None and m.mean >= (m.min + m.max) / 2)
        if len(last) > 1 and last[-1]["growth_pct"] is not None:
            step = last[-1]["growth_pct"]
            put(f"{m.column}, last step", f"{step:+g} %", f"{last[-2]['period']}: {fmt(last[-2]['value'])}, then {fmt(last[-1]['value'])}", None if step == 0 else step > 0)
        if series:
            put(f"{m.column}, dated", fmt(m.sum), f"over {series['n']} periods", True)
        if top:
            put(f"Largest {a.dimension.column}", str(top["value"])[:14], f"{fmt(top['sum'])}, {pct(top['share'])} of {m.column}", True)
    if p.get("pareto_count"):
        put("Groups within four fifths", f"{p['pareto_count']} of {p['total_contributors']}", f"the threshold is met at {pct(p['cumulative_at'])}", True if p["concentration_index"] < 30 else None)
    if odd := sum(o["n"] for o in a.facts.get("outliers", [])):
        put("Outlying values", f"{odd}", "beyond the quartile fences", False)
    return out[:8]


#: Kinds of statements, in the order in which they are told.
TOPICS = ("leader", "three", "pareto", "growth", "last", "extremes", "level", "shape", "place")


def statements(a: Analysis) -> dict[str, str]:
    """What the facts say, by kind."""
    m, d, said = a.measure, a.dimension, {}
    top, p, series, last = a.facts.get("top", []), _fact(a, "pareto"), _fact(a, "series"), a.facts.get("last_periods", [])
    if m and d and top:
        said["leader"] = f"By {m.column}, {d.column} {top[0]['value']!r} comes first: {fmt(top[0]['sum'])}, a share of {pct(top[0]['share'])}."
        if len(top) > 2:
            share = sum(t["share"] for t in top[:3])
            said["three"] = f"Its three largest {plural(d.column)} hold {pct(share)} together, so {m.column} is {'strongly' if share > 60 else 'somewhat'} concentrated."
    if m and d and p.get("pareto_count"):
        said["pareto"] = f"{p['pareto_count']} of {p['total_contributors']} {plural(d.column)} stay within four fifths of {m.column} ({pct(p['concentration_index'])} of the groups; {pct(p['cumulative_at'])} with the next one)."
    if m and series.get("n", 0) > 1:
        if (g := series["total_growth_pct"]) is not None:
            said["growth"] = f"From {series['first_period']} to {series['last_period']}, {m.column} went from {fmt(series['first_value'])} to {fmt(series['last_value'])}, {g:+g} %."
        if last[-1]["growth_pct"] is not None:
            said["last"] = f"The step from {last[-2]['period']} to {last[-1]['period']} was {last[-1]['growth_pct']:+g} %."
        said["extremes"] = f"Best was {series['peak_period']} with {fmt(series['peak_value'])}, weakest {series['trough_period']} with {fmt(series['trough_value'])}."
    if m:
        said["level"] = f"A row has {fmt(m.mean)} of {m.column} in the mean; values lie between {fmt(m.min)} and {fmt(m.max)}."
    dated = f" and dates in {a.time.column}" if a.time else ""
    said["shape"] = f"The {a.rows:,} rows have {len(a.of('measure'))} measures, {len(a.of('dimension', 'geo'))} dimensions{dated}."
    if geo := a.of("geo"):
        said["place"] = f"Places are named in {geo[0].column}, {geo[0].unique} different ones."
    return said


def insights(a: Analysis) -> list[str]:
    said = statements(a)
    return [said[k] for k in TOPICS if k in said]


def severity(n: int) -> str:
    return "high" if n > 10 else "medium" if n > 3 else "low"


def anomalies(a: Analysis) -> list[str]:
    def tell(o: dict) -> str:
        seen = f"{fmt(min(o['samples']))}" if len(o["samples"]) == 1 else f"{fmt(min(o['samples']))} up to {fmt(max(o['samples']))}"
        return f"{o['column']}: {o['n']} beyond the fences {fmt(o['low'])} and {fmt(o['high'])} (such as {seen}); severity {severity(o['n'])}."

    return [tell(o) for o in a.facts.get("outliers", [])]


def outlook(a: Analysis) -> list[str]:
    """A projection at mean growth, a word on concentration, and one on volatility (stddev over mean)."""
    m, said = a.measure, []
    if not m:
        return said
    series, p = _fact(a, "series"), _fact(a, "pareto")
    if series.get("projected") is not None:
        said.append(f"If {m.column} goes on by {series['mean_growth']:.1f} % a period, the next one comes to {fmt(series['projected'])}.")
    if p.get("pareto_count"):
        said.append(f"With so much of {m.column} in {p['pareto_count']} {plural(a.dimension.column)}, work on these few moves the total most.")
    r = a.frames["numeric"].where(F.col("column") == m.column).first() if "numeric" in a.frames else None
    if r and r["mean"] and (spread := r["stddev"] / abs(r["mean"])) > 0.2:
        said.append(f"{m.column} swings {'widely' if spread > 0.5 else 'noticeably'}: its standard deviation is {pct(spread * 100)} of its mean.")
    return said


def health_note(a: Analysis) -> str:
    nulls = a.facts["nulls"]
    cells, missing, doubled = sum(n["rows"] for n in nulls), sum(n["nulls"] for n in nulls), a.cleaned.duplicate_rows
    sparse = [n["column"] for n in nulls if n["null_pct"] > 50]
    found = []
    if missing:
        found.append(f"{missing} of {cells} cells are empty ({round(100 * missing / cells, 2):g} %)")
    if doubled:
        found.append(f"{doubled} repeated rows were taken out")
    if sparse:
        found.append(f"more than half of {', '.join(sparse)} is empty")
    return "State of the data: " + (", ".join(found) if found else "nothing to mend") + "."


def summary(a: Analysis, domain: str | None = None) -> str:
    """Shape, composition and the headline statements."""
    said = statements(a)
    about = f" ({domain})" if domain and domain != "Generic dataset" else ""
    kinds = ", ".join(f"{len(a.of(*r))} {w}" for r, w in ((("measure",), "measures"), (("dimension", "geo"), "dimensions"), (("time",), "time columns"), (("identifier",), "identifiers")))
    head = f"{a.name}{about}: {a.rows:,} rows, {len(a.cleaned.types)} columns ({kinds})."
    return " ".join([head, *[said[k] for k in ("leader", "pareto", "growth") if k in said]])


def suggestions(a: Analysis, most: int = 6) -> list[str]:
    """Questions that the analysis can answer."""
    m, d = a.measure and a.measure.column, a.dimension and a.dimension.column
    out = []
    if m and d:
        out += [f"Top 5 {plural(d)} by {m}?", f"Where is {m} lowest among {plural(d)}?", f"How evenly is {m} spread over {plural(d)}?"]
    if m and a.time:
        out.append(f"What course does {m} take over time?")
    if m:
        out.append(f"Average {m} of a row?")
    return [*dict.fromkeys([*out, "Which values are outliers?", "What does the quality score rest on?"])][:most]


def document_suggestions(keywords: list[str], most: int = 6) -> list[str]:
    """Questions to ask of documents, from their leading terms."""
    out = [f"What is said about {k}?" for k in keywords[: max(0, most - 2)]]
    return [*dict.fromkeys([*out, "What are the key passages?", "Which topics are there?"])][:most]


def quick_types(df: DataFrame, first: int = 20) -> dict[str, str]:
    """numeric or text for each column, from the first rows alone: numeric if over four fifths of their values are numbers."""
    row = df.limit(first).agg(*[F.struct(F.count(profile.q(c)).alias("n"), F.count(to_number(profile.q(c).cast("string"))).alias("k")).alias(f"c{i}") for i, c in enumerate(df.columns)]).first()
    return {c: "numeric" if row[f"c{i}"]["n"] and row[f"c{i}"]["k"] / row[f"c{i}"]["n"] > 0.8 else "text" for i, c in enumerate(df.columns)}


def default_plan(df: DataFrame, first: int = 50) -> dict:
    """Columns for an analysis from the first rows alone; an outside planner may hand `analyse` another."""
    sample = df.limit(first)
    types = profile.infer_types(sample)
    roles = olap.classify(sample, types)
    m, d = olap.primary_measure(roles), olap.primary_dimension(roles)
    t = next((r for r in roles if r.role == "time"), None)
    return {"domain": "Generic dataset", "measure": m and m.column, "dimension": d and d.column, "time": t and t.column}


def narrative(a: Analysis) -> str:
    """What an outside writer would be asked for, from the facts alone."""
    return "\n\n".join([summary(a), " ".join(insights(a)), " ".join(anomalies(a)) or "No value is beyond its fences.", health_note(a)])


def deep_dive(a: Analysis, column: str) -> str:
    """One column in words: its type and role, its gaps, and its numbers or values."""
    kind = next((t.type for t in a.cleaned.types if t.column == column), None)
    if kind is None:
        raise ValueError(f"no column {column}")
    role = next((r.role for r in a.roles if r.column == column), "none")
    gaps = next(n for n in a.facts["nulls"] if n["column"] == column)
    said = [f"{column} is of type {kind}, role {role}; {gaps['nulls']} of {gaps['rows']} values are missing."]
    if "numeric" in a.frames and (r := a.frames["numeric"].where(F.col("column") == column).first()):
        said.append(f"Mean {fmt(r['mean'])}, median {fmt(r['median'])}, standard deviation {fmt(r['stddev'])}, from {fmt(r['min'])} to {fmt(r['max'])}.")
    if "categories" in a.frames and (rows := a.frames["categories"].where(F.col("column") == column).orderBy("rank").limit(3).collect()):
        said.append(f"{rows[0]['cardinality']} values; most often " + ", ".join(f"{r['value']} ({r['n']})" for r in rows) + ".")
    return " ".join([*said, *[x for x in anomalies(a) if x.startswith(f"{column}:")]])


def chunks(a: Analysis, rows: bool = True) -> DataFrame:
    """The analysis as chunks (id, family, text) for retrieval: a frame for each family, joined by unionByName."""
    spark = a.cleaned.df.sparkSession
    data = a.cleaned.df
    told = [("summary", "summary", summary(a)), *[(f"cleaning_{i}", "cleaning", f"{x['step']} {x['column'] or 'rows'}: {x['detail']} {x['count'] if x['count'] is not None else ''}".strip()) for i, x in enumerate(a.cleaned.log)]]
    told += [(f"insight_{i}", "insights", x) for i, x in enumerate(insights(a))] + [(f"anomaly_{i}", "anomalies", x) for i, x in enumerate(anomalies(a))] + [(f"outlook_{i}", "predictions", x) for i, x in enumerate(outlook(a))]
    told += [(f"kpi_{i}", "kpis", f"{k['label']}: {k['value']} ({k['sub']})") for i, k in enumerate(kpis(a))]
    told.append(("olap", "olap_summary", f"Measures: {', '.join(r.column for r in a.of('measure')) or 'none'}; dimensions: {', '.join(r.column for r in a.of('dimension', 'geo')) or 'none'}."))
    out = [spark.createDataFrame(told, "id string, family string, text string")]

    def frame(name: str, family: str, id_: Column, *parts: Column, of: DataFrame | None = None) -> None:
        if of is not None or name in a.frames:
            df = a.frames[name] if of is None else of
            out.append(df.select(F.concat(F.lit(f"{family}_"), id_.cast("string")).alias("id"), F.lit(family).alias("family"), F.concat_ws(" ", *parts).alias("text")))

    v, c = lambda n: spoken(F.col(n)), lambda x: F.lit(x)
    frame("numeric", "column_stats", F.col("column"), F.col("column"), c("mean"), v("mean"), c("median"), v("median"), c("standard deviation"), v("stddev"), c("minimum"), v("min"), c("maximum"), v("max"), c("sum"), v("sum"))
    if "categories" in a.frames:
        values = a.frames["categories"].groupBy("column", "cardinality").agg(F.array_sort(F.collect_list(F.struct("rank", "value", "n"))).alias("top"))  # the top values of a column
        frame("", "category_stats", F.col("column"), F.col("column"), c("has"), F.col("cardinality").cast("string"), c("values:"), F.array_join(F.transform("top", lambda t: F.concat(t["value"], F.lit(" "), t["n"].cast("string"))), ", "), of=values)
    if "correlations" in a.frames:
        frame("", "correlations", F.concat_ws("_", "a", "b"), c("correlation of"), F.col("a"), c("and"), F.col("b"), c("is"), v("r"), F.col("strength"), of=profile.strong_pairs(a.frames["correlations"]))
    if "top" in a.frames:
        frame("", "top_n", F.col("value"), c(f"{a.dimension.column}"), F.col("value"), c(f"has {a.measure.column}"), v("sum"), c("share"), v("share"), of=a.frames["top"].limit(5))
        frame("pareto", "pareto", c("0"), F.col("pareto_count").cast("string"), c("of"), F.col("total_contributors").cast("string"), c(f"{plural(a.dimension.column)} within four fifths of {a.measure.column}"))
    if "periods" in a.frames:
        frame("", "periods", F.col("period"), F.col("period"), c(f"{a.measure.column}"), v("value"), c("change"), v("growth_pct"), of=a.frames["periods"].orderBy(F.desc("period")).limit(5))
    if rows:
        first = data.withColumn("__row", F.row_number().over(Window.orderBy(ROW_ID))).where("__row <= 200")  # a report's rows: each task keeps its first
        numbered = first.withColumn("__row", F.col("__row") - 1)
        out.append(retrieval.row_groups(numbered, [t.column for t in a.cleaned.types], "__row"))
    return reduce(DataFrame.unionByName, out)


def overview(a: Analysis) -> dict[str, DataFrame]:
    """The frames of an overview: eight leaders, ten Pareto rows, and seven groups of the second dimension."""
    out, data = {}, a.cleaned.df
    if a.measure and a.dimension:
        out["leaders"] = a.frames["top"].limit(8)
        out["pareto"] = olap.pareto(data, a.measure.column, a.dimension.column).orderBy("rank").limit(10)
        if second := next((r for r in a.of("dimension", "geo") if r.column != a.dimension.column), None):
            out["decomposition"] = olap.decompose(data, a.measure.column, second.column).orderBy("rank").limit(7)
    if "periods" in a.frames:
        out["periods"] = a.frames["periods"]
    return out


def workbook(a: Analysis, most_rows: int = 100_000) -> dict[str, DataFrame]:
    """The sheets of a report; the data itself up to a workbook's size (more goes to Parquet)."""
    spark = a.cleaned.df.sparkSession
    listed = lambda lines: spark.createDataFrame([(x,) for x in lines] or [("none",)], "text string")
    sheets = {"Clean Data": a.cleaned.df.orderBy(ROW_ID).limit(most_rows).drop(ROW_ID)}
    if "numeric" in a.frames:
        sheets["Statistics"] = a.frames["numeric"]
    sheets |= {"Quality": a.frames["quality"], "Insights": listed(insights(a))}
    if "correlations" in a.frames:
        sheets["Correlations"] = a.frames["correlations"]
    return sheets | {"KPIs": spark.createDataFrame([(k["label"], k["value"], k["trend"], k["sub"]) for k in kpis(a)], "label string, value string, trend string, note string")}


def bundle(a: Analysis) -> dict:
    """Meta, profiles, log and statements for `writers.json_bundle`; rows go to Parquet."""
    return {"meta": {"name": a.name, "rows": a.rows, "columns": [t.column for t in a.cleaned.types]}, "profiles": [vars(r) for r in a.roles], "types": [vars(t) for t in a.cleaned.types], "log": a.cleaned.log, "insights": insights(a), "kpis": kpis(a)}


def history_entry(a: Analysis) -> DataFrame:
    """One row for the history log."""
    from ..sources.writers import HISTORY

    q, nulls, m = a.facts["quality"][0], a.facts["nulls"], a.measure
    cells = sum(n["rows"] for n in nulls)
    kinds = [t.type for t in a.cleaned.types]
    median = a.frames["numeric"].where(F.col("column") == m.column).first()["median"] if m and "numeric" in a.frames else None
    now = datetime.now(UTC).replace(tzinfo=None)
    row = (
        f"{a.name}-{now:%Y%m%d%H%M%S%f}", now, a.name, a.rows, len(kinds), q["score"], round(100 * sum(n["nulls"] for n in nulls) / cells, 2) if cells else 0.0, a.cleaned.duplicate_rows,
        sum(k in ("integer", "number") for k in kinds), sum(k in ("category", "boolean") for k in kinds), m and m.column, m and float(m.mean), median,
        str(a.facts["top"][0]["value"]) if a.facts.get("top") else None, [t.column for t in a.cleaned.types], summary(a)[:200],
    )
    return a.cleaned.df.sparkSession.createDataFrame([row], HISTORY)
