"""Raw folder or raw tables -> star schema -> marts, each table written once."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from shelfmark.functions.naming import clean_name, require_distinct
from shelfmark.operators import stage
from shelfmark.operators.keys import settled_keys
from shelfmark.plans import dims, facts, marts, quality
from shelfmark.plans.schema import LINE_DIMENSIONS
from shelfmark.sources.workbook import WORKBOOK_ROWS
from shelfmark.sources import Rejected, Rejects, discover, read_csv, read_workbooks, sheet_table, sheets

# (layer, table name, frame) -> the frame as written
Sink = Callable[[str, str, DataFrame], DataFrame]


@dataclass(frozen=True)
class Ingested:
    """What became of a file or sheet."""

    source: str
    table: str | None
    status: str
    rejected: Mapping[str, int] = field(default_factory=dict)


def ingest_folder(
    spark: SparkSession,
    folder: str,
    sink: Sink,
    schemas: Mapping[str, StructType] | None = None,
    clean: bool = True,
    dates: Mapping[str, Mapping[str, Sequence[str]]] | None = None,
    on_reject: str = "fail",
) -> tuple[dict[str, DataFrame], list[Ingested]]:
    """Write one raw table per CSV file and per workbook sheet.

    Tables are named after the cleaned file stem or sheet name; two sources on
    one name are an error, raised before anything is written. Sources without
    rows and other files are skipped and reported. The driver handles names and
    headers only.

    ``dates`` maps table -> column -> date formats to read text by. Cells that no
    format fits, and CSV rows that do not fit a given schema, are counted by the
    write. ``on_reject="fail"`` raises :class:`Rejected` after the table with any
    is written; ``"keep"`` leaves NULLs and puts the counts in the report.
    """
    if on_reject not in ("fail", "keep"):
        raise ValueError(f"unknown on_reject {on_reject!r}")
    schemas, dates = schemas or {}, dates or {}
    files = discover(spark, folder).orderBy("path").collect()  # one row per file, no content
    frames: list[tuple[str, str, DataFrame]] = []
    report: list[Ingested] = []
    for file in files:
        if file.kind == "csv":
            name = clean_name(file.stem)
            frame = read_csv(spark, _escaped(file.path), schemas.get(name), clean, keep_corrupt=True)
            frames.append((file.path, name, frame))
        elif file.kind != "workbook":
            report.append(Ingested(file.path, None, "unsupported"))

    books = [f.path for f in files if f.kind == "workbook"]
    if books:
        # parsed once into a staged layout; the sheet tables are projections of it
        # (by sheet, so that each reads its own files)
        rows = sink(
            "staging", WORKBOOK_ROWS, read_workbooks(spark, [_escaped(b) for b in books])
        )
        with_data = {(s.file, s.sheet): s.columns for s in sheets(rows).collect()}
        for file, sheet in sorted(
            (r.file, r.sheet) for r in rows.select("file", "sheet").distinct().collect()
        ):
            source = f"{file}#{sheet}"
            if (file, sheet) not in with_data:
                report.append(Ingested(source, None, "empty"))
                continue
            name = clean_name(sheet)
            frame = sheet_table(rows, file, sheet, with_data[file, sheet], schemas.get(name))
            frames.append((source, name, frame))

    require_distinct([name for _, name, _ in frames], "table")
    tables = {}
    for source, name, frame in frames:
        if frame.isEmpty():
            report.append(Ingested(source, None, "empty"))
            continue
        rejects = Rejects(dates.get(name))
        tables[name] = sink("bronze", name, rejects.apply(frame))
        counts = rejects.counts()
        if counts and on_reject == "fail":
            raise Rejected(source, counts)
        report.append(Ingested(source, name, "written", counts))
    return tables, report


def star_plans(
    raw: Mapping[str, DataFrame],
    star: Mapping[str, DataFrame],
    lookup: str = "as_is",
    method: str = "inline",
    null_safe_geography: bool = False,
    date_formats: Sequence[str] = (),
) -> dict[str, Callable[[], DataFrame]]:
    """Table name -> plan, dimensions first. The facts look keys up in ``star``.

    ``raw`` holds ``orders``, ``people`` and ``returns``.
    """

    def orders() -> DataFrame:
        return dims.conform_orders(raw["orders"], date_formats)

    return {
        "dim_customer": lambda: dims.dim_customer(orders()),
        "dim_product": lambda: dims.dim_product(orders()),
        "dim_geography": lambda: dims.dim_geography(orders()),
        "dim_ship_mode": lambda: dims.dim_ship_mode(orders()),
        "dim_date": lambda: dims.dim_date(orders()),
        "dim_regional_manager": lambda: dims.dim_regional_manager(raw["people"]),
        "fact_sales": lambda: facts.fact_sales(
            orders(), star, lookup, method, null_safe_geography
        ),
        "fact_returns": lambda: facts.fact_returns(
            orders(), raw["returns"], star, lookup, method
        ),
    }


def build_star(
    raw: Mapping[str, DataFrame], sink: Sink, on_reject: str = "fail", **options
) -> dict[str, DataFrame]:
    """Write the star schema; options as for :func:`star_plans`.

    Text dates that cannot be read raise :class:`Rejected` before anything is
    written; ``on_reject="keep"`` makes them NULL.

    Hashes may clash: if rows of a dimension share a surrogate key, the dimension
    is written again with other keys for all but one of them, and the facts look
    those up.
    """
    star: dict[str, DataFrame] = {}
    if on_reject == "fail" and any(t == "string" for c, t in raw["orders"].dtypes if c in dims.DATES):
        unread = dims.unread_dates(raw["orders"], options.get("date_formats", ())).collect()
        if counts := {r.date_column: r.unread for r in unread if r.unread}:
            raise Rejected("orders", counts)
    for name, plan in star_plans(raw, star, **options).items():
        if name == "fact_sales":  # the line dimensions are written, no fact is
            _settle(star, sink)
        star[name] = sink("silver", name, plan())
    return star


def _settle(star: dict[str, DataFrame], sink: Sink, rounds: int = 8) -> None:
    """Rewrite dimensions until no key is on two rows."""
    tables = {d.table: d for d in LINE_DIMENSIONS}
    for _ in range(rounds):
        clashes = {r.dimension for r in quality.key_clashes(star).select("dimension").distinct().collect()}
        if not clashes:
            return
        for name in sorted(clashes):
            dim = tables[name]
            rows = stage(settled_keys(star[name], dim.key, dim.attributes), name)  # read before it is overwritten
            star[name] = sink("silver", name, rows)
    raise ValueError(f"surrogate keys on several rows after {rounds} rounds: {sorted(clashes)}")


def mart_plans(**ltv_options) -> dict[str, Callable[[Mapping[str, DataFrame]], DataFrame]]:
    """Table name -> plan over a star schema; ``ltv_options`` set the customer tiers."""
    return {
        "agg_monthly_sales": marts.monthly_sales,
        "agg_customer_lifetime_value": lambda t: marts.customer_lifetime_value(t, **ltv_options),
        "agg_product_performance": marts.product_performance,
        "agg_regional_summary": marts.regional_summary,
        "agg_category_trends": marts.category_trends,
        "agg_shipping_analysis": marts.shipping_analysis,
        "agg_state_performance": marts.state_performance,
    }


def build_marts(star: Mapping[str, DataFrame], sink: Sink, **ltv_options) -> dict[str, DataFrame]:
    """Write all seven marts."""
    return {name: sink("gold", name, plan(star)) for name, plan in mart_plans(**ltv_options).items()}


def _escaped(path: str) -> str:
    """A listed path as a reader argument: glob symbols stand for themselves."""
    return "".join(f"\\{c}" if c in "{}[]*?\\" else c for c in path)
