"""The manifest in SQL, its levels written out one by one."""

from __future__ import annotations

#: Levels of a group's tree and of the tree over groups: 16^6 rows a group, 16^3 groups.
LEVELS, UPPER = 6, 3


def crc32_sql(text: str) -> str:
    """CRC-32 of an ASCII string, a byte and a bit at a time."""
    step = "list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, i: xor(x >> 1, 3988292384 * (x & 1)))"
    codes = f"list_transform(string_split({text}, ''), lambda s: ascii(s)::BIGINT)"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {codes}), lambda c, b: {step}), 4294967295)"


def leaf_sql(fields: list[str]) -> str:
    parts = [f"CASE WHEN {f} IS NULL THEN '-' ELSE strlen({f}::VARCHAR) || ':' || {f} END" for f in fields]
    return f"sha256({' || '.join(parts)})"


def tree_sql(name: str, leaves: str, levels: int) -> str:
    """``name``0.. (g, pos, d, total): the nodes of each level; ``name``r0..: their runs. ``leaves`` gives level 0."""
    parts = [f"{name}0 AS ({leaves})"]
    for i in range(levels):
        parts.append(f"{name}r{i} AS (SELECT g, pos // 16 AS run, string_agg(d, '' ORDER BY pos) AS digests, any_value(total) AS total FROM {name}{i} GROUP BY ALL)")
        parts.append(f"{name}{i + 1} AS (SELECT g, run AS pos, CASE WHEN total > 1 THEN sha256(digests) ELSE digests END AS d, (total + 15) // 16 AS total FROM {name}r{i})")
    return ",\n".join(parts)


def way_sql(name: str, source: str, levels: int, prefix: str) -> str:
    """One table per level that adds that level's siblings to ``proof`` and folds ``now``; ``pos`` is the leaf's place."""
    parts = []
    for i in range(levels):
        left = f"substr(r.digests, 1, 64 * ((w.pos // {16**i}) % 16))"
        right = f"substr(r.digests, 64 * ((w.pos // {16**i}) % 16) + 65)"
        parts.append(f"""{prefix}{i} AS (SELECT w.* REPLACE (
  CASE WHEN r.total > 1 THEN w.proof || {left} || {right} ELSE w.proof END AS proof,
  CASE WHEN r.total > 1 THEN sha256({left} || w.now || {right}) ELSE w.now END AS now)
  FROM {source if i == 0 else f'{prefix}{i - 1}'} w JOIN {name}r{i} r ON r.g = w.g AND r.run = w.pos // {16 ** (i + 1)})""")
    return ",\n".join(parts)


FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]
CHANGED = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

MANIFEST_SQL = f"""
WITH marked AS (SELECT *, coalesce(doc_id IS NOT NULL AND {crc32_sql("coalesce(doc_id, 0)::VARCHAR")} % 5 = 0, false) AS changed FROM documents),
hashed AS (SELECT doc_id, coalesce('=' || source, '-') AS g, {leaf_sql(FIELDS)} AS leaf,
  CASE WHEN changed THEN {leaf_sql([CHANGED if f == "text" else f for f in FIELDS])} ELSE {leaf_sql(FIELDS)} END AS today FROM marked),
leaves AS (SELECT *, row_number() OVER (PARTITION BY encode(g) ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY g) AS total FROM hashed),
{tree_sql("t", "SELECT g, pos, leaf AS d, total FROM leaves", LEVELS)},
subroots AS (SELECT g AS name, d AS subroot, '' AS g, row_number() OVER (ORDER BY encode(g)) - 1 AS pos, count(*) OVER () AS total FROM t{LEVELS}),
{tree_sql("s", "SELECT g, pos, subroot AS d, total FROM subroots", UPPER)},
start AS (SELECT doc_id, g, pos, leaf, '' AS proof, today AS now FROM leaves),
{way_sql("t", "start", LEVELS, "w")},
upper AS (SELECT w.doc_id, u.g, u.pos, w.leaf, u.subroot, w.proof, w.now FROM w{LEVELS - 1} w JOIN subroots u ON u.name = w.g),
{way_sql("s", "upper", UPPER, "v")}
SELECT doc_id, leaf, subroot, (SELECT d FROM s{UPPER}) AS root, sha256(proof) AS proof_sha256, now AS folded_root,
  now = (SELECT d FROM s{UPPER}) AS verified FROM v{UPPER - 1}"""
