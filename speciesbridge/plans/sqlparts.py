"""Pieces of DuckDB SQL that say independently what the operators compute."""

from __future__ import annotations

RANK_WORDS = ("subsp", "ssp", "var", "f")


def NORM(expr: str, rank: str = "species") -> str:  # noqa: N802
    """A name's normal form, written out here apart from the operator's patterns. Blanks are single after the second step."""
    whole = f"regexp_replace(replace(trim({expr}, chr(32) || chr(9) || chr(10) || chr(13)), '_', ' '), '[\\t\\n\\x0B\\f\\r ]+', ' ', 'g')"

    def drop(e: str, tail: str) -> str:
        return f"regexp_replace({e}, '{tail}', '')"

    def keep(e: str, head: str, tail: str) -> str:
        return f"regexp_replace({e}, '^({head}){tail}$', '\\1')"

    author = r"\p{Lu}[\p{L}.]*"
    e = drop(whole, " ott[0-9]+$")
    e = drop(e, r" ?\(\p{Lu}[\p{L}.& ]*,? ?[0-9]{4}\) ?$")
    e = keep(e, "[^ ]+ [^ ]+(?: [^ ]+)?", f" {author}(?: ?(?:&|and) ?{author})*(?: ?, ?| )[0-9]{{4}} ?")
    e = keep(e, "[^ ]+ [^ ]+", r" \p{Lu}[\p{L}.]+ ?")
    e = drop(e, r" ?\([^()]*\) ?$")
    e = f"regexp_replace({e}, ' ?× ?', ' x ', 'g')"
    for word in RANK_WORDS:
        e = f"regexp_replace({e}, '\\b{word}\\.? +', '{'subsp' if word == 'ssp' else word}. ', 'g')"
    if rank == "species":
        e = keep(e, "[^ ]+ +[^ ]+", rf" +(?:{'|'.join(RANK_WORDS)})\.? +.*")
        e = keep(e, "[^ ]+ +[a-z][^ ]*", " +[a-z][^ ]*")
    # a list of one, so that the name is made once and not twice
    return f"trim(list_transform([{e}], lambda n: upper(left(n, 1)) || lower(substring(n, 2)))[1], chr(32) || chr(9) || chr(10) || chr(13))"


COLS = "name_x, name_y, name_resolved, match_type, match_score, match_source, in_x, in_y, notes"


def side(name: str, table: str, column: str, order: str, rank: str = "species", where: str = "true") -> str:
    """CTE `name`(name, pos, norm) of the distinct names of a column."""
    return (
        f"{name} AS (SELECT name, pos, {NORM('name', rank)} AS norm FROM (SELECT {column} AS name, min({order}) AS pos FROM {table}"
        f" WHERE {column} IS NOT NULL AND {where} GROUP BY 1))"
    )


def first(source: str, keys: str, order: str, where: str = "true") -> str:
    """The first row of each key, as a subquery."""
    return f"(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY {order}) AS rn FROM {source} WHERE {where}) WHERE rn = 1)"


TAXA = """taxa AS (
  SELECT from_name AS "scientificName", 'S' || xw_id AS "taxonID", 'A' || a AS "acceptedNameUsageID", 'synonym' AS "taxonomicStatus", 2 * xw_id AS ord
  FROM (SELECT *, min(xw_id) OVER (PARTITION BY to_name) AS a FROM crosswalk WHERE to_name IS NOT NULL) WHERE from_name IS NOT NULL
  UNION ALL SELECT to_name, 'A' || min(xw_id), NULL, 'accepted', 2 * min(xw_id) + 1 FROM crosswalk WHERE to_name IS NOT NULL GROUP BY to_name)"""


def lookup(names: str) -> str:
    """CTEs taxa and lookup(input, accepted_name, status, taxon_id) over the names of a query."""
    return TAXA + f""", asked AS (SELECT DISTINCT norm AS input FROM ({names}) WHERE norm IS NOT NULL),
best AS (SELECT * FROM (SELECT t.*, asked.input, row_number() OVER (PARTITION BY asked.input ORDER BY ("taxonomicStatus" = 'accepted') DESC, ord) AS rn
  FROM asked JOIN taxa t ON t."scientificName" = asked.input) WHERE rn = 1),
byid AS (SELECT "taxonID" AS id, arg_min("scientificName", ord) AS accepted FROM taxa GROUP BY 1),
lookup AS (SELECT asked.input, CASE WHEN "taxonomicStatus" = 'accepted' THEN "scientificName" ELSE accepted END AS accepted_name,
  coalesce("taxonomicStatus", 'not_found') AS status,
  CASE WHEN "taxonomicStatus" = 'accepted' OR accepted IS NULL THEN "taxonID" ELSE "acceptedNameUsageID" END AS taxon_id
  FROM asked LEFT JOIN best ON asked.input = best.input LEFT JOIN byid ON best."acceptedNameUsageID" = byid.id)"""


def similarity(gx: str, ex: str, gy: str, ey: str) -> str:
    part = lambda a, b: f"CASE WHEN greatest(length({a}), length({b})) = 0 THEN 1.0::DOUBLE ELSE 1 - levenshtein({a}, {b})::DOUBLE / greatest(length({a}), length({b})) END"
    return f"(0.6::DOUBLE * ({part(gx, gy)}) + 0.4::DOUBLE * ({part(ex, ey)}))"


def binomials(source: str) -> str:
    return f"(SELECT *, split_part(norm, ' ', 1) AS genus, split_part(norm, ' ', 2) AS epithet FROM {source} WHERE contains(norm, ' '))"


def alike(x: str, y: str, threshold: float) -> str:
    """(name_x, pos_x, norm_x, name_y, pos_y, norm_y, genus_y, score) of similar names."""
    return f"""(SELECT a.name AS name_x, a.pos AS pos_x, a.norm AS norm_x, b.name AS name_y, b.pos AS pos_y, b.norm AS norm_y, b.genus AS genus_y,
  {similarity('a.genus', 'a.epithet', 'b.genus', 'b.epithet')} AS score
  FROM {binomials(x)} a JOIN (SELECT p.genus AS g1, q.genus AS g2 FROM (SELECT DISTINCT genus FROM {binomials(x)}) p, (SELECT DISTINCT genus FROM {binomials(y)}) q
    WHERE levenshtein(p.genus, q.genus) <= 2) g ON a.genus = g.g1 JOIN {binomials(y)} b ON b.genus = g.g2 WHERE score >= {threshold})"""


def cascade(x: tuple, y: tuple, *, rank: str = "species", overrides: bool = False, authority: bool = False, resolve: str = "flag", fuzzy: bool = False, threshold: float = 0.9, flag: float = 0.95, multi_x: bool = False) -> str:
    """The CTEs of a cascade up to `result`; x, y: (table, column, order)."""
    ctes = [side("xs", *x, rank=rank), side("ys", *y, rank=rank)]
    left = lambda s, *stages: f"(SELECT * FROM {s}s WHERE " + " AND ".join(["true"] + [f"name NOT IN (SELECT name_{s} FROM {t})" for t in stages]) + ")"
    stages: list[str] = []

    def stage(name: str, select: str) -> None:
        ctes.append(f"{name} AS MATERIALIZED ({select})")
        stages.append(name)

    if overrides:
        ctes.append(f"""located AS MATERIALIZED (SELECT row_number() OVER (ORDER BY override_id) AS k, o.name_x AS ox, o.name_y AS oy, o.note, a.name AS x, b.name AS y
  FROM override_batch o LEFT JOIN {first('xs', 'norm', 'pos, name', "norm <> ''")} a ON {NORM('o.name_x', rank)} = a.norm
  LEFT JOIN {first('ys', 'norm', 'pos, name', "norm <> ''")} b ON {NORM('o.name_y', rank)} = b.norm)""")
        ctes.append("""loop(k, ux, uy, taken) AS (SELECT 0::BIGINT, []::VARCHAR[], []::VARCHAR[], false UNION ALL
  SELECT l.k, CASE WHEN ok THEN list_append(ux, x) ELSE ux END, CASE WHEN ok THEN list_append(uy, y) ELSE uy END, ok FROM (
    SELECT l.k, l.x, l.y, ux, uy, l.x IS NOT NULL AND l.y IS NOT NULL AND NOT list_contains(ux, l.x) AND NOT list_contains(uy, l.y) AS ok
    FROM loop JOIN located l ON l.k = loop.k + 1) l)""")
        ctes.append("used AS MATERIALIZED (SELECT k FROM loop WHERE taken)")
        stage("st_manual", "SELECT x AS name_x, y AS name_y, NULL AS name_resolved, 'manual' AS match_type, 1.0 AS match_score, 'user_override' AS match_source, note AS notes FROM located WHERE k IN (SELECT k FROM used)")
        ctes.append("unused AS (SELECT ox AS name_x, oy AS name_y, CASE WHEN x IS NULL THEN 'name_x_not_in_data' WHEN y IS NULL THEN 'name_y_not_in_target' ELSE 'already_matched' END AS reason FROM located WHERE k NOT IN (SELECT k FROM used))")
    stage("st_exact", f"SELECT a.name AS name_x, a.name AS name_y, NULL AS name_resolved, 'exact' AS match_type, 1.0 AS match_score, 'exact_string' AS match_source, '' AS notes FROM {left('x', *stages)} a JOIN {left('y', *stages)} b ON a.name = b.name")
    targets = first("ys" if multi_x else left("y", *stages), "norm", "pos, name", "norm <> ''")
    hits = f"(SELECT a.name AS name_x, a.pos, a.norm, b.name AS name_y FROM {left('x', *stages)} a JOIN {targets} b ON a.norm = b.norm)"
    hits = hits if multi_x else first(hits, "name_y", "pos, name_x")
    stage("st_norm", f"SELECT name_x, name_y, NULL AS name_resolved, 'normalized' AS match_type, 1.0 AS match_score, 'normalisation' AS match_source, '''' || name_x || ''' normalised to ''' || norm || '''' AS notes FROM {hits}")
    if authority:
        ctes.append(f"fx AS MATERIALIZED (SELECT * FROM {first(left('x', *stages), 'norm', 'pos, name', chr(34) + 'norm' + chr(34) + ' <> ' + repr(''))})")
        ctes.append(f"fy AS MATERIALIZED (SELECT * FROM {first(left('y', *stages), 'norm', 'pos, name', chr(34) + 'norm' + chr(34) + ' <> ' + repr(''))})")
        ctes.append(lookup("SELECT norm FROM fx UNION ALL SELECT norm FROM fy"))
        ctes.append("mx AS (SELECT fx.*, accepted_name AS acc FROM fx JOIN lookup ON norm = input WHERE accepted_name IS NOT NULL), my AS (SELECT fy.*, accepted_name AS acc FROM fy JOIN lookup ON norm = input WHERE accepted_name IS NOT NULL)")
        ctes.append("s1 AS MATERIALIZED (SELECT 1 AS strategy, mx.pos AS px, mx.norm AS nx, fy.norm AS ny, acc FROM mx JOIN fy ON mx.acc = fy.norm)")
        ctes.append(f"s2 AS MATERIALIZED (SELECT 2 AS strategy, px, nx, ny, acc FROM {first('(SELECT fx.pos AS px, fx.norm AS nx, my.norm AS ny, my.pos AS py, my.acc FROM my JOIN fx ON my.acc = fx.norm WHERE my.norm NOT IN (SELECT ny FROM s1) AND fx.norm NOT IN (SELECT nx FROM s1))', 'nx', 'py, ny')})")
        rank_zip = lambda s: f"(SELECT *, row_number() OVER (PARTITION BY acc ORDER BY pos, norm) AS n FROM m{s} WHERE norm NOT IN (SELECT n{s} FROM s1 UNION ALL SELECT n{s} FROM s2))"
        ctes.append(f"s3 AS (SELECT 3 AS strategy, a.pos AS px, a.norm AS nx, b.norm AS ny, a.acc FROM {rank_zip('x')} a JOIN {rank_zip('y')} b ON a.acc = b.acc AND a.n = b.n)")
        pairs = first("(SELECT * FROM s1 UNION ALL SELECT * FROM s2 UNION ALL SELECT * FROM s3)", "ny", "strategy, px, nx")
        kind = "CASE WHEN strategy = 3 THEN 'flagged' ELSE 'synonym' END" if resolve == "flag" else "'synonym'"
        stage("st_syn", f"""SELECT fx.name AS name_x, fy.name AS name_y, acc AS name_resolved, {kind} AS match_type, 0.95 AS match_score, 'col_synonym' AS match_source,
  CASE strategy WHEN 1 THEN 'Synonym per COL: ''' || nx || ''' -> accepted ''' || acc || '''' WHEN 2 THEN 'Synonym per COL: ''' || ny || ''' -> accepted ''' || acc || ''''
  ELSE 'Both synonyms per COL: ''' || nx || ''' and ''' || ny || ''' -> accepted ''' || acc || '''' END AS notes FROM {pairs} p JOIN fx ON fx.norm = nx JOIN fy ON fy.norm = ny""")
    if fuzzy:
        best = first(first(alike(left("x", *stages), left("y", *stages), threshold), "name_x", "score DESC, genus_y, pos_y, name_y").replace(" AS rn FROM", " AS rn0 FROM").replace("rn = 1", "rn0 = 1"), "name_y", "pos_x, name_x")
        kind = f"CASE WHEN round(score, 4) < {flag} THEN 'flagged' ELSE 'fuzzy' END" if resolve == "flag" else "'fuzzy'"
        stage("st_fuzzy", f"SELECT name_x, name_y, NULL AS name_resolved, {kind} AS match_type, round(score, 4) AS match_score, 'fuzzy_match' AS match_source, 'Fuzzy match (score ' || printf('%.3f', score) || '): ''' || norm_x || ''' ~ ''' || norm_y || '''' AS notes FROM {best}")
    parts = [f"SELECT name_x, name_y, name_resolved, match_type, match_score::DOUBLE AS match_score, match_source, true AS in_x, true AS in_y, notes FROM {t}" for t in stages]
    parts.append(f"SELECT name, NULL, NULL, 'unresolved', NULL, NULL, true, false, 'No match found in source y' FROM {left('x', *stages)}")
    parts.append(f"SELECT NULL, name, NULL, 'unresolved', NULL, NULL, false, true, 'No match found in source x' FROM {left('y', *stages)}")
    ctes.append("result AS (" + " UNION ALL ".join(parts) + ")")
    return "WITH RECURSIVE " + ",\n".join(ctes) + "\n"


CLOSURE = """up(tree_id, node, ancestor, hops, dist) AS (
  SELECT DISTINCT tree_id, n, n, 0::BIGINT, 0.0::DOUBLE FROM (SELECT tree_id, child AS n FROM tree_edges UNION SELECT tree_id, parent FROM tree_edges)
  UNION ALL SELECT u.tree_id, u.node, e.parent, u.hops + 1, u.dist + e.edge_length FROM up u JOIN tree_edges e ON u.tree_id = e.tree_id AND u.ancestor = e.child),
rt AS (SELECT DISTINCT tree_id, parent AS root FROM tree_edges e WHERE NOT EXISTS (SELECT 1 FROM tree_edges f WHERE f.tree_id = e.tree_id AND f.child = e.parent)),
tip AS (SELECT tree_id, child, label FROM tree_edges WHERE is_tip),
ta AS (SELECT up.*, tip.label FROM up JOIN tip ON up.tree_id = tip.tree_id AND up.node = tip.child)"""
