"""The same queries as plain SQL, written from the definitions.

Sets are counted with ``count(DISTINCT ...)`` per grouping set, straight from the
selected elems, so nothing here shares the library's way of counting.
"""

from __future__ import annotations

_ELEMS = """
tagged AS (
    SELECT *,
           CASE WHEN l_orderkey % 5 = 0 THEN 'R'
                WHEN l_suppkey % 7 = 6 THEN 'S'
                WHEN l_returnflag = 'R' AND l_linenumber = 1 THEN 'W'
                ELSE 'A' END AS elem_type,
           CAST(64500 + l_suppkey % 7 AS VARCHAR) AS a,
           CAST(1000 + l_orderkey % 17 AS VARCHAR) AS t1,
           CASE WHEN l_discount > 0.095 THEN '23456'
                WHEN l_tax > 0.075 THEN '{65001,65002}'
                WHEN l_quantity > 48 THEN CAST(40000 + l_partkey % 500 AS VARCHAR)
                ELSE CAST(30000 + l_partkey % 500 AS VARCHAR) END AS path_end
    FROM lineitem
),
elems AS (
    SELECT l_orderkey AS record_id,
           CASE WHEN l_orderkey % 7 <= 2 THEN 'routeviews'
                WHEN l_orderkey % 7 <= 5 THEN 'ris' ELSE 'other' END AS project,
           CASE l_orderkey % 7 WHEN 0 THEN 'route-views.sg' WHEN 1 THEN 'route-views.sg'
                WHEN 2 THEN 'route-views2' WHEN 3 THEN 'rrc00' WHEN 4 THEN 'rrc00'
                WHEN 5 THEN 'rrc01' ELSE 'other00' END AS collector,
           CASE WHEN l_orderkey % 5 = 0 THEN 'ribs' ELSE 'updates' END AS record_type,
           CAST(1451606400 + (l_orderkey % 3) * 86400 + (l_orderkey * 37) % 86400 AS BIGINT)
               AS record_time,
           CAST(64500 + l_suppkey % 7 AS BIGINT) AS peer_asn,
           CASE WHEN l_suppkey % 5 = 0 THEN '2001:db8::' ELSE '192.0.2.' END
               || CAST(l_suppkey % 7 AS VARCHAR) AS peer_address,
           CASE WHEN elem_type = 'S' THEN NULL
                WHEN l_partkey % 4 = 0
                THEN '2001:db8:' || CAST(l_partkey % 9000 AS VARCHAR) || '::/48'
                ELSE '10.' || CAST((l_partkey // 256) % 256 AS VARCHAR) || '.'
                     || CAST(l_partkey % 256 AS VARCHAR) || '.0/24' END AS prefix,
           CASE WHEN elem_type NOT IN ('R', 'A') THEN NULL
                WHEN l_linenumber = 7 THEN ''
                WHEN l_linenumber = 6 THEN a
                ELSE a || ' ' || CASE WHEN l_linenumber = 3 THEN a || ' ' ELSE '' END
                     || t1 || ' ' || CASE WHEN l_linenumber = 2 THEN t1 || ' ' ELSE '' END
                     || CASE WHEN l_linenumber = 4 THEN ''
                             ELSE CAST(2000 + l_suppkey % 11 AS VARCHAR) || ' ' END
                     || path_end END AS as_path,
           CASE WHEN elem_type NOT IN ('R', 'A') THEN NULL
                WHEN l_linenumber = 5 THEN ''
                WHEN l_linenumber = 1 THEN a || ':' || CAST(l_orderkey % 20 AS VARCHAR)
                WHEN l_linenumber = 2 THEN t1 || ':' || CAST(l_partkey % 10 AS VARCHAR)
                ELSE a || ':' || CAST(l_orderkey % 20 AS VARCHAR) || ' '
                     || t1 || ':' || CAST(l_partkey % 10 AS VARCHAR) END AS communities,
           elem_type
    FROM tagged
)"""

_IN_PROJECTS = "project IN ('routeviews', 'ris')"
_UPDATES = f"record_type = 'updates' AND record_time < 1451779200 AND {_IN_PROJECTS}"
_RIBS = f"record_type = 'ribs' AND record_time < 1451865600 AND {_IN_PROJECTS}"
_ONE_COLLECTOR = "record_type = 'updates' AND record_time < 1451865600 AND collector = 'other00'"


def _selected(condition: str) -> str:
    return f"""{_ELEMS},
selected AS (
    SELECT *, CAST((record_time // 86400) * 86400 AS BIGINT) AS time,
           CASE WHEN prefix LIKE '%:%' THEN 6 WHEN prefix IS NOT NULL THEN 4 END AS family
    FROM elems
    WHERE record_time >= 1451606400 AND {condition}
)"""


def _group_by_levels(*extra: str) -> str:
    tail = "".join(f", {column}" for column in extra)
    return (f"GROUP BY GROUPING SETS ((time, collector, project, peer_asn, peer_address{tail}),"
            f" (time, collector{tail}), (time{tail}))")


_KEYS = "time, collector, project, peer_asn, peer_address"
_LEVEL = "grouping(collector) + grouping(peer_address)"
_LABELS = """time,
       CASE WHEN level = 2 THEN 'ALL-COLLECTORS' ELSE collector END AS collector,
       CASE WHEN level > 0 THEN 'ALL-PEERS'
            ELSE 'AS' || CAST(peer_asn AS VARCHAR) || '-' || peer_address END AS peer"""

# Whitespace tokens; hops with adjacent repeats removed; hops without first and last.
_TOKENS = "list_filter(string_split_regex(as_path, '\\s+'), lambda x: x <> '')"
_HOPS = "string_split(as_path, ' ')"
_SQUASHED = (f"list_filter({_HOPS},"
             f" lambda x, i: i = 1 OR x <> list_extract({_HOPS}, i - 1))")
_ORIGIN = f"coalesce({_TOKENS}[-1], '')"
_VALID = f"{_ORIGIN} NOT IN ('', '23456') AND NOT contains({_ORIGIN}, '{{')"
_PAIRS = "string_split(communities, ' ')"


def _elem_counts(where: str) -> str:
    return f"""WITH {_selected(where)},
counted AS (
    SELECT {_KEYS}, {_LEVEL} AS level,
           count(*) AS elem_cnt, count(DISTINCT record_id) AS record_cnt
    FROM selected {_group_by_levels()}
)
SELECT {_LABELS}, elem_cnt, record_cnt FROM counted"""


def _routing_table(where: str, *, names: tuple[str, ...] = (
        "pfxs_v4", "pfxs_v6", "asns_v4", "asns_v6"), titles: bool = False) -> str:
    labels = _legacy_labels() if titles else _LABELS
    columns = ", ".join(f'c{i} AS "{name}"' for i, name in enumerate(names))
    return f"""WITH {_selected(where)},
tokened AS (
    SELECT *, unnest(CASE WHEN len({_TOKENS}) > 0 THEN {_TOKENS} ELSE [NULL] END) AS asn
    FROM selected
),
counted AS (
    SELECT {_KEYS}, {_LEVEL} AS level,
           count(DISTINCT prefix) FILTER (WHERE family = 4) AS c0,
           count(DISTINCT prefix) FILTER (WHERE family = 6) AS c1,
           count(DISTINCT asn) FILTER (WHERE family = 4) AS c2,
           count(DISTINCT asn) FILTER (WHERE family = 6) AS c3
    FROM tokened {_group_by_levels()}
)
SELECT {labels}, {columns} FROM counted"""


def _legacy_labels() -> str:
    return (_LABELS.replace("time,", 'time AS "Time",', 1)
            .replace("AS collector,", 'AS "Collector",').replace("AS peer", 'AS "Peer"'))


def _origins(where: str) -> str:
    return f"""{_selected(where)},
origins AS (
    SELECT {_KEYS}, family, prefix, {_LEVEL} AS level, count(DISTINCT origin) AS n,
           list(DISTINCT origin ORDER BY origin) FILTER (WHERE origin IS NOT NULL) AS origins
    FROM (SELECT *, CASE WHEN {_VALID} THEN {_ORIGIN} END AS origin FROM selected)
    {_group_by_levels("family", "prefix")}
)"""


def _moas(where: str) -> str:
    columns = ",\n           ".join(
        f"""count(prefix) FILTER (WHERE family = {f}) AS total_v{f},
           count(prefix) FILTER (WHERE family = {f} AND n > 1) AS moas_pfxs_v{f},
           count(prefix) FILTER (WHERE family = {f} AND n = 0) AS unknown_origin_pfxs_v{f},
           count(DISTINCT origins) FILTER (WHERE family = {f} AND n > 1) AS origin_sets_v{f}"""
        for f in (4, 6))
    return f"""WITH {_origins(where)},
counted AS (
    SELECT {_KEYS}, level, {columns}
    FROM origins GROUP BY {_KEYS}, level
)
SELECT {_LABELS}, * EXCLUDE ({_KEYS}, level) FROM counted"""


def _moas_legacy(where: str) -> str:
    columns = ", ".join(
        [f'count(prefix) FILTER (WHERE family = {f}) AS "Total_IPv{f}"' for f in (4, 6)]
        + [f'count(prefix) FILTER (WHERE family = {f} AND n <> 1) AS "#Pfxs_v{f}"'
           for f in (4, 6)]
        + [f"count(DISTINCT coalesce(origins, [])) FILTER (WHERE family = {f} AND n <> 1)"
           f' AS "#Origin_Sets_IPv{f}"' for f in (4, 6)])
    return f"""WITH {_origins(where)},
counted AS (SELECT {_KEYS}, level, {columns} FROM origins GROUP BY {_KEYS}, level)
SELECT {_legacy_labels()}, * EXCLUDE ({_KEYS}, level) FROM counted"""


def _origin_table(condition: str) -> str:
    return f"""WITH {_origins(_UPDATES)}
SELECT {_LABELS}, family, prefix, coalesce(array_to_string(origins, ' '), '') AS origins
FROM origins WHERE {condition}"""


def _hopped(where: str) -> str:
    return f"""{_selected(where)},
hopped AS (
    SELECT *, unnest(CASE WHEN prefix <> '' AND len({_SQUASHED}) > 2
                          THEN ({_SQUASHED})[2:len({_SQUASHED}) - 1] ELSE [NULL] END) AS transit
    FROM selected
),
per_transit AS (
    SELECT {_KEYS}, family, transit, {_LEVEL} AS level, count(DISTINCT prefix) AS n
    FROM hopped WHERE transit IS NOT NULL {_group_by_levels("family", "transit")}
)"""


def _transit(where: str, titles: bool = False) -> str:
    totals, stats, chosen = [], [], []
    for f in (4, 6):
        totals += [
            f"count(DISTINCT prefix) FILTER (WHERE family = {f}) AS total_v{f}",
            f"count(DISTINCT transit) FILTER (WHERE family = {f}) AS transit_asns_v{f}",
            f"count(DISTINCT prefix) FILTER (WHERE family = {f} AND transit IS NOT NULL)"
            f" AS transit_pfxs_v{f}",
        ]
        for name, call in (("min", "min(n)"), ("mean", "avg(n)"), ("max", "max(n)"),
                           ("std", "stddev_pop(n)")):
            stats.append(f"{call} FILTER (WHERE family = {f}) AS {name}_pfxs_v{f}")
    if titles:
        labels = _legacy_labels()
        chosen += [f'total_v{f} AS "Total_IPv{f}"' for f in (4, 6)]
        chosen += [f'transit_asns_v{f} AS "#Pfxs_v{f}"' for f in (4, 6)]
    else:
        labels = _LABELS
        chosen += [f"{name}_v{f}" for name in ("total", "transit_asns", "transit_pfxs")
                   for f in (4, 6)]
    for f in (4, 6):
        for name in ("min", "mean", "max", "std"):
            value = f"coalesce({name}_pfxs_v{f}, 0)"
            if name in ("mean", "std"):
                value = f"round({value}, 6)"
            title = f"#{name.capitalize()}_Pfxs_v{f}" if titles else f"{name}_pfxs_v{f}"
            chosen.append(f'{value} AS "{title}"')
    same = " AND ".join(f"c.{key.strip()} IS NOT DISTINCT FROM s.{key.strip()}"
                        for key in f"{_KEYS}, level".split(","))
    return f"""WITH {_hopped(where)},
counted AS (
    SELECT {_KEYS}, {_LEVEL} AS level, {", ".join(totals)}
    FROM hopped {_group_by_levels()}
),
statistics AS (
    SELECT {_KEYS}, level, {", ".join(stats)} FROM per_transit GROUP BY {_KEYS}, level
),
joined AS (
    SELECT c.*, s.* EXCLUDE ({_KEYS}, level) FROM counted c LEFT JOIN statistics s ON {same}
)
SELECT {labels}, {", ".join(chosen)} FROM joined"""


def _transit_detail() -> str:
    return f"""WITH {_hopped(_UPDATES)}
SELECT {_LABELS}, family, transit AS transit_asn, n AS pfx_cnt FROM per_transit"""


def _tagged_communities(where: str) -> str:
    return f"""{_selected(where)},
listed AS (
    SELECT *, unnest(CASE WHEN prefix <> '' AND communities <> '' THEN {_PAIRS}
                          ELSE [NULL] END) AS community
    FROM selected
),
parsed AS (
    SELECT *, CAST(split_part(community, ':', 1) AS BIGINT) AS asn,
           CAST(split_part(community, ':', 2) AS BIGINT) AS value
    FROM listed
)"""


def _community(where: str, titles: bool = False) -> str:
    parts = (
        ("Total_IPv{}", "total_ipv{}", "prefix", "TRUE"),
        ("#Pfx_v{}_ANY", "pfx_v{}_any", "prefix", "community IS NOT NULL"),
        ("#Pfx_v{}_Int", "pfx_v{}_int", "prefix", "asn = peer_asn"),
        ("#Pfx_v{}_Ext", "pfx_v{}_ext", "prefix", "asn <> peer_asn"),
        ("#ASN_v{}", "asn_v{}", "asn", "TRUE"),
        ("#ASN-Value_v{}", "asn_value_v{}", "community", "TRUE"),
    )
    columns = ", ".join(
        f"count(DISTINCT {what}) FILTER (WHERE family = {f} AND {condition})"
        f' AS "{(title if titles else name).format(f)}"'
        for title, name, what, condition in parts for f in (4, 6))
    # Conditions on peer_asn must see the elem's own peer, not the rolled-up key.
    return f"""WITH {_tagged_communities(where)},
flagged AS (SELECT *, peer_asn AS elem_peer FROM parsed),
counted AS (
    SELECT {_KEYS}, {_LEVEL} AS level,
           {columns.replace("= peer_asn", "= elem_peer").replace("<> peer_asn", "<> elem_peer")}
    FROM flagged {_group_by_levels()}
)
SELECT {_legacy_labels() if titles else _LABELS}, * EXCLUDE ({_KEYS}, level) FROM counted"""


def _community_detail() -> str:
    return f"""WITH {_tagged_communities(_UPDATES)},
counted AS (
    SELECT {_KEYS}, family, asn, value, {_LEVEL} AS level, count(DISTINCT prefix) AS pfx_cnt
    FROM parsed WHERE community IS NOT NULL {_group_by_levels("family", "asn", "value")}
)
SELECT {_LABELS}, family, asn, value, pfx_cnt FROM counted"""


_REPORTS = {
    "elem_counts": _elem_counts,
    "routing_table": _routing_table,
    "moas": _moas,
    "transit": _transit,
    "community": _community,
}

#: The same rows with the awkward ones of ``checks.edges``, and the SQL above over them.
_EDGES = """,
edges AS (
    SELECT * REPLACE (
        CASE WHEN prefix IS NOT NULL AND record_id % 11 = 0 THEN '' ELSE prefix END AS prefix,
        CASE record_id % 6
             WHEN 1 THEN replace(as_path, ' ', '  ')
             WHEN 2 THEN as_path || ' ' || CAST(peer_asn AS VARCHAR)
             WHEN 3 THEN ' ' || as_path || '   '
             WHEN 4 THEN replace(as_path, ' ', chr(9))
             WHEN 5 THEN CAST(peer_asn AS VARCHAR) || ' {1,2} ' || as_path
             ELSE as_path END AS as_path)
    FROM elems
)"""


def _over_edges(sql: str) -> str:
    return sql.replace(_ELEMS, _ELEMS + _EDGES).replace("FROM elems\n    WHERE", "FROM edges\n    WHERE")


def _by_hour(sql: str) -> str:
    return sql.replace("(record_time // 86400) * 86400", "(record_time // 3600) * 3600")


def _hours_and_days(sql: str) -> str:
    return f"""SELECT *, CAST(3600 AS INTEGER) AS span FROM ({_by_hour(sql)}) hours
UNION ALL BY NAME SELECT *, CAST(86400 AS INTEGER) AS span FROM ({sql}) days"""


ORACLE: dict[str, str] = {
    "select_elems": f"WITH {_selected(_UPDATES)} SELECT * EXCLUDE (family) FROM selected",
    "collectors_in_projects":
        f"WITH {_ELEMS} SELECT DISTINCT project, collector FROM elems WHERE {_IN_PROJECTS}",
    "catalog_selection": f"""WITH {_selected(_UPDATES)}
SELECT time, project, collector, count(*) AS elem_cnt
FROM selected GROUP BY time, project, collector""",
    "family_prefix_counts": f"""WITH {_selected(_UPDATES)},
counted AS (
    SELECT {_KEYS}, {_LEVEL} AS level,
           count(DISTINCT prefix) FILTER (WHERE family = 4) AS pfxs_v4,
           count(DISTINCT prefix) FILTER (WHERE family = 6) AS pfxs_v6
    FROM selected {_group_by_levels()}
)
SELECT {_LABELS}, pfxs_v4, pfxs_v6 FROM counted""",
    "path_tokens": f"""WITH {_ELEMS}
SELECT asn, count(*) AS cnt FROM (SELECT unnest({_TOKENS}) AS asn FROM elems) GROUP BY asn""",
    "path_squash": f"""WITH {_ELEMS}
SELECT DISTINCT as_path, array_to_string({_SQUASHED}, ' ') AS squashed,
       len({_SQUASHED}) AS hop_cnt
FROM elems WHERE as_path IS NOT NULL""",
    "path_origin": f"""WITH {_ELEMS}
SELECT DISTINCT as_path, {_ORIGIN} AS origin, {_VALID} AS is_valid FROM elems""",
    "path_transit": f"""WITH {_ELEMS}
SELECT DISTINCT as_path, unnest(({_SQUASHED})[2:len({_SQUASHED}) - 1]) AS transit_asn
FROM elems WHERE len({_SQUASHED}) > 2""",
    "community_explode": f"""WITH {_ELEMS},
listed AS (SELECT peer_asn, unnest({_PAIRS}) AS pair FROM elems WHERE communities <> ''),
parsed AS (
    SELECT peer_asn, CAST(split_part(pair, ':', 1) AS BIGINT) AS asn,
           CAST(split_part(pair, ':', 2) AS BIGINT) AS value
    FROM listed
)
SELECT peer_asn, asn, value, asn = peer_asn AS is_internal, count(*) AS cnt
FROM parsed GROUP BY ALL""",
    "level_labels": f"""WITH {_selected(_UPDATES)},
counted AS (
    SELECT {_KEYS}, CAST({_LEVEL} AS INTEGER) AS level, count(*) AS elem_cnt
    FROM selected {_group_by_levels()}
)
SELECT {_LABELS}, level, elem_cnt FROM counted""",
    "prefix_origins": _origin_table("prefix IS NOT NULL"),
    "moas_detail": _origin_table("n > 1"),
    "transit_detail": _transit_detail(),
    "community_detail": _community_detail(),
    **{kind: sql(_UPDATES) for kind, sql in _REPORTS.items()},
    **{f"{kind}_ribs": sql(_RIBS) for kind, sql in _REPORTS.items()},
    **{f"{kind}_one_collector": sql(_ONE_COLLECTOR) for kind, sql in _REPORTS.items()},
    # The collectors that a catalogue of covered projects lists, whatever their rows say.
    "catalog_that_disagrees": f"""WITH {_selected("record_type = 'updates' AND record_time < 1451779200"
        " AND collector IN ('route-views.sg', 'rrc00', 'other00')")}
SELECT time, project, collector, count(*) AS elem_cnt FROM selected GROUP BY time, project, collector""",
    "elem_counts_bitmaps": _elem_counts(_UPDATES),
    "elem_counts_bitmaps_ribs": _elem_counts(_RIBS),
    "edge_paths": f"""WITH {_ELEMS}{_EDGES}
SELECT DISTINCT as_path, array_to_string({_SQUASHED}, ' ') AS squashed, {_ORIGIN} AS origin,
       len({_SQUASHED}) AS hop_cnt, len({_TOKENS}) AS token_cnt
FROM edges WHERE as_path IS NOT NULL""",
    **{f"{kind}_edges": _over_edges(sql(_UPDATES)) for kind, sql in _REPORTS.items()},
    "prefix_origins_edges": _over_edges(_origin_table("prefix IS NOT NULL")),
    **{f"{kind}_from_records": _REPORTS[kind](_UPDATES) for kind in ("elem_counts", "community")},
    **{f"{kind}_by_hour": _by_hour(sql(_UPDATES)) for kind, sql in _REPORTS.items()},
    **{f"{kind}_hours_and_days": _hours_and_days(sql(_UPDATES)) for kind, sql in _REPORTS.items()},
    "routing_table_legacy": _routing_table(
        _UPDATES, names=("#Pfxs_v4", "#Pfxs_v6", "#ASNs_v4", "#ASNs_v6"), titles=True),
    "moas_legacy": _moas_legacy(_UPDATES),
    "transit_legacy": _transit(_UPDATES, titles=True),
    "community_legacy": _community(_UPDATES, titles=True),
}
