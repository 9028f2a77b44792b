"""Alignments with their maps, contacts, descriptors and chemistry of structures made of vectors."""

from __future__ import annotations

from pyspark.sql import functions as F

from auditframe.operators import alignment, contacts
from auditframe.plans.registry import query, six, sql_six, table

#: Residue names of the test structures, by the vector's number.
RESIDUES = ["ALA", "ARG", "ASN", "ASP", "CYS", "GLN", "GLU", "GLY", "HIS", "ILE", "LEU", "LYS", "MET", "PHE", "PRO", "SER", "THR", "TRP", "TYR", "VAL"]
ATOMS = ["CA", "N", "O", "CB", "OG", "ND2", "OD1", "NE2"]

ATOMS_SQL = f"""a AS (SELECT vec_id // 50 AS s, vec_id % 50 AS pos, ({RESIDUES})[vec_id % 20 + 1] AS residue, unnest({ATOMS}) AS atom, unnest(range(0, 8)) AS k, embedding AS e FROM embeddings),
    atoms AS (SELECT s, pos, residue, atom, 40 * e[1]::DOUBLE + 8 * e[3 * k + 4]::DOUBLE AS x, 40 * e[2]::DOUBLE + 8 * e[3 * k + 5]::DOUBLE AS y, 40 * e[3]::DOUBLE + 8 * e[3 * k + 6]::DOUBLE AS z,
        atom NOT IN ('N', 'CA', 'C', 'O', 'OXT') AS side,
        (atom = 'N' AND residue <> 'PRO') OR (residue, atom) IN (('ARG', 'NE'), ('ARG', 'NH1'), ('ARG', 'NH2'), ('ASN', 'ND2'), ('GLN', 'NE2'), ('HIS', 'ND1'), ('HIS', 'NE2'), ('LYS', 'NZ'), ('SER', 'OG'), ('THR', 'OG1'), ('TRP', 'NE1'), ('TYR', 'OH')) AS gives,
        atom IN ('O', 'OXT') OR (residue, atom) IN (('ASP', 'OD1'), ('ASP', 'OD2'), ('ASN', 'OD1'), ('GLU', 'OE1'), ('GLU', 'OE2'), ('GLN', 'OE1'), ('HIS', 'ND1'), ('HIS', 'NE2'), ('SER', 'OG'), ('THR', 'OG1')) AS takes FROM a),
    near AS (SELECT l.s, l.pos, l.residue, r.pos AS pos2, r.residue AS residue2, l.side AND r.side AS sides, (l.gives AND r.takes) OR (l.takes AND r.gives) AS link, sqrt((l.x - r.x) ** 2 + (l.y - r.y) ** 2 + (l.z - r.z) ** 2) AS d FROM atoms l JOIN atoms r ON l.s = r.s AND abs(l.pos - r.pos) > 2),
    pairs AS (SELECT s, pos, residue, pos2, residue2, coalesce(min(d) FILTER (WHERE sides) <= 4.5, false) AS side, coalesce(min(d) FILTER (WHERE link) <= 3.5, false) AS bonded FROM near GROUP BY ALL HAVING min(d) <= 4.5)"""


def atoms(spark, sf):
    """Structures of fifty vectors; a vector is a residue of eight atoms about the point of its first three numbers."""
    e = F.col("embedding")
    rows = table(spark, sf, "embeddings").select(F.floor(F.col("vec_id") / 50).alias("s"), (F.col("vec_id") % 50).alias("pos"), F.element_at(F.lit(RESIDUES), (F.col("vec_id") % 20 + 1).cast("int")).alias("residue"), "embedding", F.posexplode(F.lit(ATOMS)).alias("k", "atom"))
    axes = [(40 * e[i].cast("double") + 8 * e[3 * F.col("k") + 3 + i].cast("double")).alias(c) for i, c in enumerate("xyz")]
    return rows.select("s", "pos", "residue", "atom", *axes)


@query(f"""WITH {ATOMS_SQL}, p AS (SELECT * FROM atoms WHERE atom = 'CA'), t AS (SELECT s, count(*)::DOUBLE AS n, var_pop(x) AS xx, var_pop(y) AS yy, var_pop(z) AS zz, covar_pop(x, y) AS xy, covar_pop(x, z) AS xz, covar_pop(y, z) AS yz FROM p GROUP BY s HAVING count(*) >= 4),
    c AS (SELECT l.s, count(*) AS k, avg(r.pos - l.pos) AS m, avg((r.pos - l.pos >= 24)::INT) AS lr FROM p l JOIN p r ON l.s = r.s AND r.pos - l.pos > 2 AND sqrt((l.x - r.x) ** 2 + (l.y - r.y) ** 2 + (l.z - r.z) ** 2) <= 8 GROUP BY l.s),
    j AS (SELECT t.*, xx + yy + zz AS tr, coalesce(k, 0) AS k, m, lr FROM t LEFT JOIN c USING (s))
    SELECT s, n::BIGINT AS n, {sql_six('sqrt(tr) / cbrt(n)')} AS radius_normalized, k AS contact_count, {sql_six('2 * k / n')} AS contacts_per_residue, {sql_six('k / greatest(n * (n - 1) / 2 - (2 * n - 3), 1)')} AS contact_density, {sql_six('coalesce(m / n, 0)')} AS relative_contact_order,
    {sql_six('coalesce(lr, 0)')} AS long_range, {sql_six('n / (4.0::DOUBLE / 3 * pi() * sqrt(tr) ** 3)')} AS compactness, {sql_six('1.5 * (xx * xx + yy * yy + zz * zz + 2 * (xy * xy + xz * xz + yz * yz) - tr * tr / 3) / (tr * tr)')} AS asphericity FROM j""")
def chain_descriptors(spark, sf):
    """Radius, contacts, contact order, compactness and asphericity of each structure's chain."""
    out = contacts.chain_descriptors(atoms(spark, sf).where("atom = 'CA'"), "s", "pos")
    return out.select("s", "n", "contact_count", *(six(F.col(c)).alias(c) for c in out.columns if c not in ("s", "n", "contact_count")))


SHARES = ["polar_polar", "hydrophobic_hydrophobic", "hydrophobic_polar", "aromatic_aromatic", "polar_partner", "nonpolar_partner"]
_IN = {name: str(tuple(values)) for name, values in (("P", contacts.POLAR), ("H", contacts.HYDROPHOBIC), ("A", contacts.AROMATIC))}
_CLASSES = [f"residue IN {_IN['P']} AND residue2 IN {_IN['P']}", f"residue IN {_IN['H']} AND residue2 IN {_IN['H']}", f"(residue IN {_IN['H']} AND residue2 IN {_IN['P']}) OR (residue IN {_IN['P']} AND residue2 IN {_IN['H']})", f"residue IN {_IN['A']} AND residue2 IN {_IN['A']}", f"residue2 IN {_IN['P']}", f"residue2 IN {_IN['H']}"]


@query(f"""WITH {ATOMS_SQL}, k AS (SELECT s, pos, count(*) AS contacts, count(*) FILTER (WHERE side) AS side_contacts, count(*) FILTER (WHERE bonded) AS bonded, {', '.join(f'count(*) FILTER (WHERE side AND ({c})) AS {n}' for n, c in zip(SHARES, _CLASSES, strict=True))} FROM pairs GROUP BY s, pos),
    c AS (SELECT DISTINCT s, pos FROM atoms) SELECT s, pos, {', '.join(f'coalesce({c}, 0) AS {c}' for c in ('contacts', 'side_contacts', 'bonded', *SHARES))}, {sql_six('bonded / contacts')} AS bonded_share, {', '.join(f"{sql_six(f'{c} / nullif(side_contacts, 0)')} AS {c}_share" for c in SHARES)} FROM c LEFT JOIN k USING (s, pos)""")
def contact_chemistry(spark, sf):
    """Contacts of each residue by the classes of both side chains, and hydrogen bonds from donor and acceptor distances."""
    own = atoms(spark, sf)
    out = contacts.contact_chemistry(contacts.residue_pairs(own, "s", "pos"), own, ["s", "pos"])
    return out.select(*(six(F.col(c)).alias(c) if c.endswith("_share") else c for c in out.columns))


@query(f"""WITH {ATOMS_SQL}, p AS (SELECT * FROM atoms WHERE atom = 'CA'), n AS (SELECT l.s, l.pos, r.pos AS pos2, r.residue AS residue2 FROM p l JOIN p r ON l.s = r.s AND abs(l.pos - r.pos) > 2 AND sqrt((l.x - r.x) ** 2 + (l.y - r.y) ** 2 + (l.z - r.z) ** 2) <= 8),
    k AS (SELECT n.s, n.pos, n.residue2, count(*) AS n, count(pairs.pos) AS touch FROM n LEFT JOIN pairs USING (s, pos, pos2) GROUP BY ALL), e AS (SELECT s, pos, sum(n)::BIGINT AS n, sum(touch)::BIGINT AS touch, string_agg('"' || residue2 || '": ' || n, ', ' ORDER BY residue2) AS items FROM k GROUP BY s, pos)
    SELECT p.s, p.pos, coalesce(n, 0) AS neighbours, '{{' || coalesce(items, '') || '}}' AS composition, coalesce(touch, 0) AS contact_density FROM p LEFT JOIN e USING (s, pos)""")
def sphere_neighbours(spark, sf):
    """Neighbours in a sphere about each residue, their composition, and those in contact."""
    own = atoms(spark, sf)
    return contacts.sphere_neighbours(own.where("atom = 'CA'"), contacts.residue_pairs(own, "s", "pos"), "s", "pos")


@query("""WITH p AS (SELECT a.s_suppkey AS id, b.s_suppkey AS other, a.s_name AS a, b.s_name AS b, length(a.s_name) AS m FROM supplier a JOIN supplier b ON a.s_suppkey <> b.s_suppkey),
    h AS (SELECT *, list_sum(list_transform(range(1, m + 1), lambda i: (a[i] <> b[i])::INT)) AS h FROM p),
    d AS (SELECT DISTINCT id, other FROM (SELECT id, other, b, a[:i - 1] || a[i + 1:] AS less, unnest(range(1, m + 1)) AS j FROM (SELECT *, unnest(range(1, m + 1)) AS i FROM h WHERE h >= 3)) WHERE less = b[:j - 1] || b[j + 1:]),
    s AS (SELECT id, other, CASE WHEN h <= 1 THEN (m - h) / m WHEN d.id IS NOT NULL THEN (m - 1) / m END AS identity FROM h LEFT JOIN d USING (id, other))
    SELECT id, arg_min(other, (-round(identity, 9), other)) AS best, round(max(identity), 6) + 0.0 AS identity FROM s WHERE identity >= 0.9 GROUP BY id""")
def best_in_length_band(spark, sf):
    """The supplier whose name aligns best with each, among names of about its length: one letter changed, or one lost and one put in."""
    rows = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("s"))
    return alignment.best_in_band(rows, rows, "id", "s", 2, 0.9).select("id", "best", six(F.col("identity")).alias("identity"))


@query("""WITH t AS (SELECT item_id, item_id % 3 AS kind, length(text) - 20 AS n, (length(text) - 20) // 2 AS half FROM benchmark)
    SELECT item_id, ['exact', 'aligned', 'unmapped'][kind + 1] AS how, CASE kind WHEN 0 THEN 1 WHEN 1 THEN round((n - 4) / (n - 3), 6) END AS identity, CASE kind WHEN 2 THEN 0 WHEN 1 THEN n - 3 ELSE n END AS pairs, CASE WHEN kind < 2 THEN 10 END AS first, CASE WHEN kind < 2 THEN n + 9 END AS last FROM t""")
def mapped_sequences(spark, sf):
    """Each text's inner part laid on the text: as it is, with three letters lost and one changed, and with every other letter changed."""
    part = F.substring(F.col("text"), F.lit(11), F.length("text") - 20)
    half = F.floor((F.length("text") - 20) / 2).cast("int")
    changed = F.concat(F.substring(part, F.lit(1), half), F.substring(part, half + 4, F.lit(20)), F.lit("#"), F.substring(part, half + 25, F.length("text")))
    spoilt = F.array_join(F.transform(F.split(part, ""), lambda c, i: F.when(i % 2 == 0, "#").otherwise(c)), "")
    rows = table(spark, sf, "benchmark").select("item_id", "text", F.when(F.col("item_id") % 3 == 0, part).when(F.col("item_id") % 3 == 1, changed).otherwise(spoilt).alias("part"))
    m = F.col("m")
    out = rows.select("item_id", alignment.mapped("text", "part").alias("m"))
    passes = m["how"] != "unmapped"
    ends = (F.when(passes, F.element_at(m["target"], i)) for i in (1, -1))
    return out.select("item_id", m["how"].alias("how"), F.when(passes, F.round(m["identity"], 6)).alias("identity"), F.size(m["target"]).alias("pairs"), *(c.alias(n) for c, n in zip(ends, ("first", "last"), strict=True)))
