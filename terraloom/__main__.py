"""Commands: python -m terraloom COMMAND."""

from __future__ import annotations

import argparse


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="terraloom", description=__doc__)
    sub = p.add_subparsers(dest="command", required=True)
    c = sub.add_parser("reconstruct", help="points of one kind of file to an archive of tables")
    c.add_argument("path"), c.add_argument("out"), c.add_argument("--kind"), c.add_argument("--area", help="x,y,size"), c.add_argument("--terrain", type=float, default=1.0)
    c = sub.add_parser("inspect", help="what an archive holds")
    c.add_argument("path")
    c = sub.add_parser("tiles", help="the LAS files of a folder that meet an area, densest first")
    c.add_argument("path"), c.add_argument("--area", help="x,y,size")
    sub.add_parser("adapters", help="the formats that are read")
    c = sub.add_parser("explain", help="which rules fit a role with flags, best first")
    c.add_argument("role"), c.add_argument("flags", nargs="*")
    sub.add_parser("queries", help="the names of all queries")
    c = sub.add_parser("run", help="run a query over a folder of tables")
    c.add_argument("query"), c.add_argument("sf_dir"), c.add_argument("--rows", type=int, default=20, help="how many rows to show")
    return p


def _box(area: str | None) -> tuple[float, float, float, float] | None:
    if not area:
        return None
    x, y, size = map(float, area.split(","))
    return x - size / 2, y - size / 2, x + size / 2, y + size / 2


def main(args: list[str] | None = None) -> None:
    a = parser().parse_args(args)
    from .plans import views
    from .plans.queries import QUERIES
    from .session import local_session

    if a.command == "queries":
        print("\n".join(sorted(QUERIES)))
        return
    spark = local_session()
    if a.command == "reconstruct":
        from .plans.reconstruct import Config, reconstruct
        from .sources import clouds, sinks

        points = clouds.datum(clouds.read(spark, a.path, a.kind, box=_box(a.area)))
        sinks.write_archive(reconstruct(points, Config(terrain=a.terrain)), a.out, {"from": a.path})
        sinks.inspect(spark, a.out).show(truncate=False)
    elif a.command == "inspect":
        from .sources import sinks

        sinks.inspect(spark, a.path).show(truncate=False)
    elif a.command == "tiles":
        from .operators import tiles
        from .sources import clouds

        found = clouds.headers(spark, a.path)
        (tiles.query(found, _box(a.area)) if a.area else tiles.density(found)).show(truncate=False)
    elif a.command == "adapters":
        from .sources import clouds

        clouds.adapters(spark).show(truncate=False)
    elif a.command == "explain":
        from pyspark.sql import functions as F

        from .functions.bits import mask
        from .operators import rules

        request = spark.createDataFrame([(a.role, mask(a.flags, views.FLAGS), None)], "role string, ctx long, semantic string")
        rules.matches(request, views.rules(spark)).orderBy(F.desc("r_priority"), F.desc("r_specificity"), "r_ordinal").show(truncate=False)
    elif a.command == "run":
        QUERIES[a.query](spark, a.sf_dir).show(a.rows, truncate=False)


if __name__ == "__main__":
    main()
