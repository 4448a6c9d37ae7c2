"""Scoreboard, season and standings payloads as rows; a payload without its array is unavailable (no row, not an empty list)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomwork.functions import matches as M
from loomwork.operators.prefix import running_totals

TEAM = "team struct<id:string,displayName:string,name:string,abbreviation:string>"
SCOREBOARD = f"""events array<struct<id:string,date:string,season:struct<slug:string>,status:struct<type:struct<name:string,state:string>>,
 competitions:array<struct<venue:struct<fullName:string,address:struct<city:string>>,competitors:array<struct<homeAway:string,score:string,{TEAM.replace(' ', ':', 1)}>>>>>>"""
SEASON = """events array<struct<idEvent:string,strTimestamp:string,dateEvent:string,strTime:string,strStatus:string,strPostponed:string,intRound:string,
 strVenue:string,strHomeTeam:string,intHomeScore:string,strAwayTeam:string,intAwayScore:string>>"""
STANDINGS = f"children array<struct<name:string,standings:struct<entries:array<struct<{TEAM.replace(' ', ':', 1)},stats:array<struct<name:string,value:double>>>>>>>"


def _events(payloads: DataFrame, schema: str) -> DataFrame:
    keep = [c for c in payloads.columns if c != "payload"]
    return payloads.withColumn("p", F.from_json("payload", schema)).select(*keep, F.posexplode("p.events").alias("ord", "ev"))


def available(payloads: DataFrame, schema: str) -> Column:
    """Whether a payload has its array, possibly empty: the test for falling back to another source."""
    return F.from_json("payload", schema)["events"].isNotNull()


def _score(text: Column, status: Column) -> Column:
    return F.when(M.has_score(status), M.leading_int(text))


def scoreboard(payloads: DataFrame, groups: DataFrame | None = None) -> DataFrame:
    """Canonical matches of scoreboard payloads; groups(team_id, label) name the group of group-stage matches."""
    ev = _events(payloads, SCOREBOARD)
    comp = F.get(F.col("ev.competitions"), F.lit(0))
    sides = comp["competitors"]
    pick = lambda flag, at: F.coalesce(F.get(F.filter(sides, lambda c: c["homeAway"] == flag), F.lit(0)), F.get(sides, F.lit(at)))
    status = M.feed_status(F.col("ev.status.type.name"), F.col("ev.status.type.state"))
    rows = ev.withColumns({"comp": comp, "home": pick("home", 0), "away": pick("away", 1), "status": status, "slug": F.col("ev.season.slug")})
    team = lambda c: F.struct(F.coalesce(M.filled(c["team"]["displayName"]), M.filled(c["team"]["name"]), F.lit("?")).alias("name"), F.coalesce(c["team"]["abbreviation"], F.lit("")).alias("code"), _score(c["score"], F.col("status")).alias("score"))
    if groups is not None:
        # a group list has a row for each team: some dozens
        by = lambda n: F.broadcast(groups.select(F.col("team_id").alias(f"{n}_id"), F.col("label").alias(f"{n}_label")))
        rows = rows.join(by("h"), F.col("home.team.id") == F.col("h_id"), "left").join(by("a"), F.col("away.team.id") == F.col("a_id"), "left")
        label = F.when(F.col("slug") == "group-stage", F.coalesce(M.filled(F.col("h_label")), M.filled(F.col("a_label"))))
    else:
        label = F.lit(None).cast("string")
    keep = [c for c in payloads.columns if c != "payload"]
    return rows.select(
        *keep, F.col("ord").cast("long").alias("ord"), F.col("ev.id").alias("id"), F.col("ev.date").alias("utcDate"), M.instant(F.col("ev.date")).alias("kickoff"), "status",
        label.alias("group"), F.when(M.filled(F.col("slug")).isNotNull() & (F.col("slug") != "group-stage"), M.slug_title(F.col("slug"))).alias("stage"),
        M.venue_line(F.col("comp.venue.fullName"), F.col("comp.venue.address.city")).alias("venue"), team(F.col("home")).alias("homeTeam"), team(F.col("away")).alias("awayTeam"),
    )


def season(payloads: DataFrame) -> DataFrame:
    """Canonical matches of season-list payloads."""
    ev = _events(payloads, SEASON).withColumn("status", M.season_status(F.col("ev.strStatus"), F.coalesce(F.col("ev.strPostponed"), F.lit(""))))
    team = lambda n, s: F.struct(F.coalesce(M.filled(n), F.lit("?")).alias("name"), F.coalesce(M.lookup(M.NAME_TO_CODE, F.lower(n)), F.lit("")).alias("code"), _score(s, F.col("status")).alias("score"))
    stamp = M.completed_instant(F.col("ev.strTimestamp"), F.col("ev.dateEvent"), F.col("ev.strTime"))
    keep = [c for c in payloads.columns if c != "payload"]
    return ev.select(
        *keep, F.col("ord").cast("long").alias("ord"), F.col("ev.idEvent").alias("id"), stamp.alias("utcDate"), M.instant(stamp).alias("kickoff"), "status",
        F.nullif(M.leading_int(F.col("ev.intRound")), F.lit(0)).alias("matchday"), M.filled(F.col("ev.strVenue")).alias("venue"),
        team(F.col("ev.strHomeTeam"), F.col("ev.intHomeScore")).alias("homeTeam"), team(F.col("ev.strAwayTeam"), F.col("ev.intAwayScore")).alias("awayTeam"),
    )


#: Statistic names of a standings entry and their columns.
STATS = {"rank": "pos", "gamesPlayed": "played", "wins": "won", "ties": "draw", "losses": "lost", "pointsFor": "gf", "pointsAgainst": "ga", "pointDifferential": "gd", "points": "pts"}


def pivot_stats(rows: DataFrame, keys: list[str], name: str = "name", value: str = "value", order: str = "ord", stats: dict[str, str] | None = None) -> DataFrame:
    """Statistic rows to one wide row for each key; the last of a repeated name counts, a missing one is 0."""
    wanted = (stats or STATS).items()
    return rows.groupBy(*keys).agg(*[F.coalesce(F.max_by(value, F.when(F.col(name) == k, F.col(order))), F.lit(0)).alias(c) for k, c in wanted])


def standings(payloads: DataFrame) -> DataFrame:
    """Table rows of standings payloads: places of group and entry, group, team and the nine statistics; see nested() and group_index()."""
    groups = payloads.withColumn("p", F.from_json("payload", STANDINGS)).select(F.posexplode("p.children").alias("g_ord", "child"))
    entries = groups.select("g_ord", F.coalesce(M.filled(F.col("child.name")), F.lit("Group")).alias("group"), M.filled(F.col("child.name")).isNotNull().alias("named"), F.posexplode("child.standings.entries").alias("e_ord", "e"))
    last = lambda k: F.element_at(F.filter(F.coalesce("e.stats", F.array().cast("array<struct<name:string,value:double>>")), lambda s: s["name"] == k), -1)
    stat = lambda k: F.coalesce(F.when(F.exists(F.coalesce("e.stats", F.array().cast("array<struct<name:string,value:double>>")), lambda s: s["name"] == k), last(k)["value"]), F.lit(0.0)).cast("int")
    t = F.col("e.team")
    return entries.select("g_ord", "e_ord", "group", "named", t["id"].alias("team_id"), F.coalesce(M.filled(t["displayName"]), M.filled(t["name"]), F.lit("?")).alias("team"), F.coalesce(t["abbreviation"], F.lit("")).alias("code"), *[stat(k).alias(c) for k, c in STATS.items()])


def nested(table: DataFrame) -> DataFrame:
    """(group, table) in the order of group names as people sort them; each table in the order of pos, ties as they came.

    One row for each group of a payload; groups of equal name stay apart.
    """
    fields = [c for c in table.columns if c not in ("g_ord", "e_ord", "group", "named")]
    row = F.struct(F.col("pos").alias("p_"), F.col("e_ord").alias("e_"), F.struct(*fields).alias("row"))
    groups = table.groupBy("g_ord", "group").agg(F.transform(F.sort_array(F.collect_list(row)), lambda x: x["row"]).alias("table"))
    return groups.orderBy(F.expr("`group` COLLATE UNICODE"), "g_ord").select("group", "table")


def placed_groups(table: DataFrame) -> DataFrame:
    """(group_place, group, table): nested() with each group's place from 0, whatever order rows come in."""
    groups = nested(table.withColumn("g_", F.col("g_ord")))
    first = F.get("table", F.lit(0))["g_"]
    ranked = running_totals(groups.withColumn("g_ord", first), [], [F.expr("`group` COLLATE UNICODE"), F.col("g_ord")], {"group_place": F.lit(1).cast("long")}, before=True)
    return ranked.select("group_place", "group", "table")


def group_index(table: DataFrame) -> DataFrame:
    """(team_id, label): the group of each team that has an id; of a team in two groups the later one; an unnamed group is ''."""
    seen = table.filter(M.filled(F.col("team_id")).isNotNull())
    return seen.groupBy("team_id").agg(F.max_by(F.when(F.col("named"), F.col("group")).otherwise(""), F.struct("g_ord", "e_ord")).alias("label"))


def first_available(*sources: tuple[DataFrame, str, Callable[[DataFrame], DataFrame]]) -> DataFrame | None:
    """Rows of the first source that is available: one of its payloads has the array, possibly empty.

    A source is (payloads, schema, parser).  Null if none is available.
    """
    for payloads, schema, parse in sources:
        if not payloads.filter(available(payloads, schema)).isEmpty():
            return parse(payloads)
    return None
