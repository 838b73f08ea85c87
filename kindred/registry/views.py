"""Domain-shaped views over the driver tables; one SQL text for Spark and for the oracle.

The tables hold orders, parts and events.  These views read them as calls, mutations,
intervals and so on: every view uses whole tables and only renames, maps or aggregates.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

BASE = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()

_HEX = "'0123456789abcdef', 'NCGTACGTACGTACGT'"
_CLEAN_HEX = "'0123456789abcdef', 'ACGTACGTACGTACGT'"


def _fl(x: str) -> str:
    return f"CAST(floor({x}) AS BIGINT)"


_EPOCH = {
    "spark": "CAST(timestampdiff(SECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', {ts}) AS BIGINT)",
    "duck": "CAST(floor(epoch({ts})) AS BIGINT)",
}


_EVERY12 = {"spark": "explode(sequence(1, 12))", "duck": "unnest(range(1, 13))"}


def view_sql(engine: str) -> dict[str, str]:
    """View name -> SQL.  Only the second-of-epoch expression differs between the engines."""
    epoch = _EPOCH[engine].format(ts="ts")
    every12 = _EVERY12[engine]
    return {
        # --- calls: site = order, sample = order line --------------------------------
        "calls": """
            SELECT 'c_' || CAST(o.o_custkey % 12 + 1 AS STRING) AS chrom,
                   CAST(c.ok * 2 + 1 AS BIGINT) AS pos,
                   substr('ACGT', CAST(c.ok % 4 + 1 AS INT), 1) AS ref,
                   substr('ACGT', CAST((c.ok + 1 + c.ok % 3) % 4 + 1 AS INT), 1) AS alt,
                   CASE WHEN o.o_orderstatus = 'P' THEN 'gatk_germline' ELSE 'PASS' END AS filter,
                   'SP_family' || CAST(c.ok % 4 + 1 AS STRING) AS family,
                   CASE c.ln WHEN 1 THEN 'F' WHEN 2 THEN 'M'
                        ELSE 'S' || CAST(c.ln - 2 AS STRING) END AS role,
                   'SP_family' || CAST(c.ok % 4 + 1 AS STRING) || '_' ||
                     CASE c.ln WHEN 1 THEN 'F_female' WHEN 2 THEN 'M_male'
                          ELSE 'S' || CAST(c.ln - 2 AS STRING) || '_offspring' END AS sample,
                   CAST(c.q AS INT) AS dp,
                   CAST(40 + c.p % 60 AS INT) AS gq,
                   CASE WHEN c.ln <= 2
                        THEN CASE WHEN c.p % 10 < 8 THEN '0/0' WHEN c.p % 10 = 8 THEN '0/1' ELSE '1/1' END
                        ELSE CASE WHEN c.p % 10 < 5 THEN '0/1' WHEN c.p % 10 < 8 THEN '0/0' ELSE '1/1' END
                   END AS gt,
                   CAST(floor(c.q * (20 + c.s % 60) / 100) AS INT) AS alt_dp,
                   CAST(c.q AS INT) - CAST(floor(c.q * (20 + c.s % 60) / 100) AS INT) AS ref_dp
            FROM (SELECT l_orderkey AS ok, l_linenumber AS ln, min(l_quantity) AS q,
                         min(l_partkey) AS p, min(l_suppkey) AS s
                  FROM lineitem GROUP BY l_orderkey, l_linenumber) c
            JOIN orders o ON o.o_orderkey = c.ok""",
        # --- the same calls, one row per site with an entry per sample (Spark only) --------
        "site_calls": """
            SELECT 'c_' || CAST(o.o_custkey % 12 + 1 AS STRING) AS chrom,
                   CAST(c.ok * 2 + 1 AS BIGINT) AS pos,
                   substr('ACGT', CAST(c.ok % 4 + 1 AS INT), 1) AS ref,
                   substr('ACGT', CAST((c.ok + 1 + c.ok % 3) % 4 + 1 AS INT), 1) AS alt,
                   CASE WHEN o.o_orderstatus = 'P' THEN 'gatk_germline' ELSE 'PASS' END AS filter,
                   transform(sequence(0, 27), i -> CASE WHEN i div 7 = c.ok % 4 THEN
                     transform(array(c.calls[i % 7]), x -> CASE WHEN x.q IS NOT NULL THEN named_struct(
                       'gt', CASE WHEN i % 7 < 2
                             THEN CASE WHEN x.p % 10 < 8 THEN '0/0' WHEN x.p % 10 = 8 THEN '0/1' ELSE '1/1' END
                             ELSE CASE WHEN x.p % 10 < 5 THEN '0/1' WHEN x.p % 10 < 8 THEN '0/0' ELSE '1/1' END END,
                       'dp', CAST(x.q AS INT),
                       'gq', CAST(40 + x.p % 60 AS INT),
                       'ref_dp', CAST(x.q AS INT) - CAST(floor(x.q * (20 + x.s % 60) / 100) AS INT),
                       'alt_dp', CAST(floor(x.q * (20 + x.s % 60) / 100) AS INT)) END)[0] END) AS calls
            FROM (SELECT l_orderkey AS ok, array("""
            + ", ".join(
                f"named_struct('q', min(l_quantity) FILTER (WHERE l_linenumber = {k}), "
                f"'p', min(l_partkey) FILTER (WHERE l_linenumber = {k}), "
                f"'s', min(l_suppkey) FILTER (WHERE l_linenumber = {k}))"
                for k in range(1, 8)
            )
            + """) AS calls FROM lineitem GROUP BY l_orderkey) c
            JOIN orders o ON o.o_orderkey = c.ok""",
        # --- the same calls, one row per site with the seven calls of its family (Spark only) ----
        "family_calls": """
            SELECT 'c_' || CAST(o.o_custkey % 12 + 1 AS STRING) AS chrom,
                   CAST(c.ok * 2 + 1 AS BIGINT) AS pos,
                   'SP_family' || CAST(c.ok % 4 + 1 AS STRING) AS family,
                   substr('ACGT', CAST(c.ok % 4 + 1 AS INT), 1) AS ref,
                   substr('ACGT', CAST((c.ok + 1 + c.ok % 3) % 4 + 1 AS INT), 1) AS alt,
                   CASE WHEN o.o_orderstatus = 'P' THEN 'gatk_germline' ELSE 'PASS' END AS filter,
                   transform(c.calls, (x, i) -> CASE WHEN (c.there & shiftleft(1, i)) <> 0 THEN named_struct(
                     'gt', CASE WHEN i < 2
                           THEN CASE WHEN x.p % 10 < 8 THEN '0/0' WHEN x.p % 10 = 8 THEN '0/1' ELSE '1/1' END
                           ELSE CASE WHEN x.p % 10 < 5 THEN '0/1' WHEN x.p % 10 < 8 THEN '0/0' ELSE '1/1' END END,
                     'dp', CAST(x.q AS INT),
                     'gq', CAST(40 + x.p % 60 AS INT),
                     'ref_dp', CAST(x.q AS INT) - CAST(floor(x.q * (20 + x.s % 60) / 100) AS INT),
                     'alt_dp', CAST(floor(x.q * (20 + x.s % 60) / 100) AS INT)) END) AS calls
            FROM (SELECT l_orderkey AS ok,
                         bit_or(CASE WHEN l_linenumber BETWEEN 1 AND 7 THEN shiftleft(1, l_linenumber - 1) ELSE 0 END) AS there, array("""
            + ", ".join(
                f"named_struct('q', min(l_quantity) FILTER (WHERE l_linenumber = {k}), "
                f"'p', min(l_partkey) FILTER (WHERE l_linenumber = {k}), "
                f"'s', min(l_suppkey) FILTER (WHERE l_linenumber = {k}))"
                for k in range(1, 8)
            )
            + """) AS calls FROM lineitem GROUP BY l_orderkey) c
            JOIN orders o ON o.o_orderkey = c.ok""",
        # --- sites with a bit for each call of their family (Spark only) --------------------------
        "called_sites": """
            SELECT 'c_' || CAST(o.o_custkey % 12 + 1 AS STRING) AS chrom,
                   CAST(c.ok * 2 + 1 AS BIGINT) AS pos,
                   substr('ACGT', CAST(c.ok % 4 + 1 AS INT), 1) AS ref,
                   'SP_family' || CAST(c.ok % 4 + 1 AS STRING) AS family, c.called
            FROM (SELECT l_orderkey AS ok, bit_or(shiftleft(1, l_linenumber - 1)) AS called
                  FROM lineitem WHERE l_linenumber BETWEEN 1 AND 7 GROUP BY l_orderkey) c
            JOIN orders o ON o.o_orderkey = c.ok""",
        "mean_depth": """
            SELECT sample, chrom, avg(dp) AS mean_depth, count(*) AS n_sites
            FROM calls GROUP BY sample, chrom""",
        "samples": """
            SELECT 'family' || CAST(k AS STRING) AS family,
                   CASE ln WHEN 1 THEN 'F' WHEN 2 THEN 'M' ELSE 'S' || CAST(ln - 2 AS STRING) END AS role,
                   'SP_family' || CAST(k AS STRING) || '_' ||
                     CASE ln WHEN 1 THEN 'F_female' WHEN 2 THEN 'M_male'
                          ELSE 'S' || CAST(ln - 2 AS STRING) || '_offspring' END AS sample
            FROM (SELECT l_orderkey % 4 + 1 AS k, l_linenumber AS ln FROM lineitem
                  GROUP BY l_orderkey % 4 + 1, l_linenumber HAVING count(*) > 0) x""",
        "sex": """
            SELECT sample AS ind,
                   CASE WHEN role IN ('S1', 'S3', 'S5') THEN 'male' ELSE 'female' END AS sex_id
            FROM samples WHERE role LIKE 'S%'""",
        "trios": """
            SELECT s.family, p.mother, p.father, s.sample AS child
            FROM samples s
            JOIN (SELECT family, max(CASE WHEN role = 'F' THEN sample END) AS mother,
                         max(CASE WHEN role = 'M' THEN sample END) AS father
                  FROM samples GROUP BY family) p ON p.family = s.family
            WHERE s.role LIKE 'S%'""",
        # --- site annotations ---------------------------------------------------------
        "sites": """
            SELECT 'c_' || CAST(o_custkey % 12 + 1 AS STRING) AS chrom,
                   CAST(o_orderkey * 2 + 1 AS BIGINT) AS pos,
                   substr('ACGT', CAST(o_orderkey % 4 + 1 AS INT), 1) AS ref,
                   CASE WHEN o_custkey % 9 = 0 THEN substr('ACGT', CAST(o_orderkey % 4 + 1 AS INT), 1) || 'T'
                        ELSE substr('ACGT', CAST((o_orderkey + 1) % 4 + 1 AS INT), 1) END AS alt,
                   CASE WHEN o_custkey % 7 = 0 THEN '.' ELSE 'rs' || CAST(o_orderkey AS STRING) END AS vid,
                   CASE WHEN o_custkey % 11 = 0 THEN NULL ELSE CAST(o_custkey % 40 AS DOUBLE) / 10 END AS qd,
                   CAST(30 + o_orderkey % 40 AS DOUBLE) AS mq,
                   CAST(o_orderkey % 80 AS DOUBLE) AS fs,
                   CAST(o_custkey % 45 AS DOUBLE) / 10 AS sor,
                   CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE CAST(o_orderkey % 30 AS DOUBLE) - 14.0 END AS mqranksum,
                   CAST(o_custkey % 20 AS DOUBLE) - 9.0 AS readposranksum,
                   CASE WHEN o_orderkey % 13 = 0 THEN NULL ELSE CAST(o_orderkey % 100 AS DOUBLE) / 100 END AS af,
                   CAST(o_custkey % 60 AS DOUBLE) AS qual,
                   CAST(o_orderkey % 90 AS INT) AS dp,
                   CAST(o_orderkey % 37 AS STRING) || ',' || CAST(o_custkey % 5 AS STRING) || ',' ||
                     CAST(o_orderkey % 23 AS STRING) || ',' || CAST(o_custkey % 3 AS STRING) AS dp4,
                   CASE CAST(o_orderkey % 7 AS INT) WHEN 0 THEN '0/0' WHEN 1 THEN '1|1' WHEN 2 THEN './.'
                        WHEN 3 THEN '1|0' ELSE '0/1' END AS gt
            FROM orders""",
        # --- sequence: 32-base tiles with one overlapping base on each side --------------
        "genome": f"""
            SELECT chrom, tile, tile * 32 AS tile_start,
                   CASE WHEN tile = 0 THEN 'N'
                        ELSE translate(substr(md5(chrom || ':' || CAST(tile - 1 AS STRING)), 32, 1), {_HEX}) END
                   || translate(md5(chrom || ':' || CAST(tile AS STRING)), {_HEX})
                   || translate(substr(md5(chrom || ':' || CAST(tile + 1 AS STRING)), 1, 1), {_HEX}) AS seq
            FROM (SELECT 'c_' || CAST(k AS STRING) AS chrom, tile FROM (SELECT {every12} AS k, tile
                  FROM (SELECT DISTINCT {_fl('o_orderkey * 2 / 32')} AS tile FROM orders) u) v) t""",
        # --- the same sequence in tiles of the package's width (Spark only) -----------------
        # dealt out while they are short rows: the texts are spelled out by many tasks, not one
        "genome_tiles": f"""
            SELECT chrom, tile, tile * 32768 AS tile_start,
                   CASE WHEN tile = 0 THEN 'N'
                        ELSE translate(substr(md5(chrom || ':' || CAST(first - 1 AS STRING)), 32, 1), {_HEX}) END
                   || array_join(transform(sequence(first, last),
                                           i -> translate(md5(chrom || ':' || CAST(i AS STRING)), {_HEX})), '')
                   || translate(substr(md5(chrom || ':' || CAST(last + 1 AS STRING)), 1, 1), {_HEX}) AS seq
            FROM (SELECT /*+ REPARTITION(64, chrom, tile) */ 'c_' || CAST(k AS STRING) AS chrom, tile, first, last
                  FROM (SELECT tile, first, last, {every12} AS k
                        FROM (SELECT {_fl('o_orderkey * 2 / 32768')} AS tile, min({_fl('o_orderkey * 2 / 32')}) AS first,
                                     max({_fl('o_orderkey * 2 / 32')}) AS last
                              FROM orders GROUP BY {_fl('o_orderkey * 2 / 32768')}) u) v) t""",
        # --- gene models: gene, two transcripts, four CDS parts each ------------------------
        "cds": f"""
            SELECT 'g' || CAST(gene AS STRING) AS gene,
                   'g' || CAST(gene AS STRING) || '.t' || CAST({_fl('k / 4')} % 2 + 1 AS STRING) AS mrna,
                   'c_' || CAST(gene % 12 + 1 AS STRING) AS chrom,
                   CASE WHEN gene % 2 = 0 THEN '+' ELSE '-' END AS strand,
                   gene * 110 + k % 4 * 26 + 1 AS start,
                   gene * 110 + k % 4 * 26 + 1 + p_size % 26 AS stop, k AS file_order
            FROM (SELECT CAST(p_partkey AS BIGINT) AS k, {_fl('p_partkey / 8')} AS gene, p_size FROM part) x""",
        "aln": f"""
            SELECT 'g' || CAST(l_partkey AS STRING) AS gene, 'SP' || CAST(l_suppkey % 3 AS STRING) AS species,
                   substr(translate(md5(CAST(l_partkey AS STRING) || ':' || CAST(l_suppkey % 3 AS STRING)), {_HEX}), 1, 30) AS seq
            FROM (SELECT DISTINCT l_partkey, l_suppkey % 3 AS l_suppkey FROM lineitem) x""",
        # --- mutations ------------------------------------------------------------------
        "dnm": f"""
            SELECT 'c_' || CAST(l_partkey % 12 + 1 AS STRING) AS chrom,
                   CAST(l_partkey * 37 + 1 AS BIGINT) AS pos,
                   substr('ACGT', CAST(l_partkey % 4 + 1 AS INT), 1) AS ref,
                   substr('ACGT', CAST((l_partkey + 1 + l_partkey % 3) % 4 + 1 AS INT), 1) AS alt,
                   'SP' || CAST(l_suppkey % 7 AS STRING) AS species,
                   'SP' || CAST(l_suppkey % 7 AS STRING) || '_family' || CAST(l_suppkey % 3 + 1 AS STRING) AS family,
                   'SP' || CAST(l_suppkey % 7 AS STRING) || '_family' || CAST(l_suppkey % 3 + 1 AS STRING)
                     || '_S' || CAST(l_orderkey % 4 + 1 AS STRING) || '_offspring' AS child,
                   'SP' || CAST(l_suppkey % 7 AS STRING) || '_family' || CAST(l_suppkey % 3 + 1 AS STRING)
                     || '_M_male' AS father,
                   'SP' || CAST(l_suppkey % 7 AS STRING) || '_family' || CAST(l_suppkey % 3 + 1 AS STRING)
                     || '_F_female' AS mother,
                   substr('ACGT', CAST({_fl('l_partkey / 4')} % 4 + 1 AS INT), 1) AS n_before,
                   substr('ACGT', CAST(l_partkey % 4 + 1 AS INT), 1) AS nuc_ref,
                   substr('ACGT', CAST({_fl('l_partkey / 16')} % 4 + 1 AS INT), 1) AS nuc_after,
                   CASE WHEN l_tax >= 0.08 THEN 'F' WHEN l_returnflag = 'A' THEN 'P'
                        WHEN l_returnflag = 'R' AND l_linestatus = 'O' THEN 'M' ELSE 'U' END AS phased
            FROM lineitem""",
        "callable_bp": """
            SELECT species, family, child, chrom, CAST(1000 * count(*) + 100000 AS BIGINT) AS bp,
                   child || '_' || chrom AS ind_chrom
            FROM dnm GROUP BY species, family, child, chrom""",
        "trinuc": """
            SELECT species, child, chrom, trinuc, CAST(sum(n) AS BIGINT) AS n FROM (
              SELECT species, child, chrom,
                     n_before || CASE WHEN ref IN ('A', 'C') THEN 'C' ELSE 'T' END || nuc_after AS trinuc,
                     length(child) * 5000 + 400 AS n
              FROM dnm) x GROUP BY species, child, chrom, trinuc""",
        "somatic": f"""
            SELECT 'SP' || CAST(l_suppkey % 7 AS STRING) AS species,
                   CASE WHEN l_partkey % 3 = 1 THEN 'T' ELSE 'C' END AS oriented_ref,
                   substr('ACGT', CAST({_fl('l_extendedprice')} % 4 + 1 AS INT), 1) AS oriented_alt,
                   substr('ACGT', CAST(l_orderkey % 4 + 1 AS INT), 1)
                     || CASE WHEN l_linenumber = 7 THEN 'N' WHEN l_partkey % 3 = 1 THEN 'T' ELSE 'C' END
                     || substr('ACGT', CAST({_fl('l_orderkey / 4')} % 4 + 1 AS INT), 1) AS oriented_context,
                   CAST(l_quantity AS BIGINT) AS coverage
            FROM lineitem""",
        "species_dim": """
            SELECT DISTINCT 'SP' || CAST(s_suppkey % 7 AS STRING) AS species,
                   CASE WHEN s_suppkey % 7 < 3 THEN 'social' ELSE 'subsocial' END AS sociality,
                   CAST((s_suppkey * 3) % 7 AS INT) AS leaf_order
            FROM supplier""",
        "group_members": """
            SELECT 'all_species' AS group_name, species FROM species_dim
            UNION ALL SELECT sociality AS group_name, species FROM species_dim
            UNION ALL SELECT 'even_leaf' AS group_name, species FROM species_dim WHERE leaf_order % 2 = 0""",
        # --- intervals, depth -------------------------------------------------------------
        "ivals": """
            SELECT 'c_' || CAST(l_suppkey % 12 + 1 AS STRING) AS chrom,
                   CAST(l_orderkey * 100 AS BIGINT) AS start,
                   CAST(l_orderkey * 100 + l_quantity * 20 AS BIGINT) AS stop,
                   'off' || CAST(l_linenumber AS STRING) AS offspring,
                   CAST(l_partkey % 60 AS INT) AS depth
            FROM lineitem""",
        "chrom_len": """
            SELECT 'c_' || CAST(o_custkey % 12 + 1 AS STRING) AS chrom,
                   CAST(max(o_orderkey) * 100 + 1500 AS BIGINT) AS length
            FROM orders GROUP BY 'c_' || CAST(o_custkey % 12 + 1 AS STRING)""",
        "depth": """
            SELECT 'c_' || CAST(l_suppkey % 12 + 1 AS STRING) AS chrom,
                   'ind' || CAST(l_linenumber AS STRING) AS sample,
                   CAST(l_orderkey AS BIGINT) AS pos,
                   CAST(CASE WHEN l_discount > 0.09 THEN 0 ELSE l_quantity END AS INT) AS depth
            FROM lineitem""",
        "features": """
            SELECT 'c_' || CAST(s_suppkey % 12 + 1 AS STRING) AS chrom,
                   CASE WHEN s_suppkey % 4 = 0 THEN 'gene' ELSE 'exon' END AS feature_type,
                   'g' || CAST(s_suppkey % 25 AS STRING) || '.t1.exon' || CAST(s_suppkey AS STRING) AS feature_id,
                   CAST(s_suppkey * 150 + 1 AS BIGINT) AS start,
                   CAST(s_suppkey * 150 + 700 + s_nationkey * 40 AS BIGINT) AS stop
            FROM supplier""",
        "points": f"""
            SELECT user_id, {epoch} AS pos, event_type, value FROM events""",
        # --- sequencing lanes: supplier = flowcell, customer = individual -----------------
        "lanes": """
            SELECT r.r_name AS species, 'family' || CAST(c.c_custkey % 25 + 1 AS STRING) AS family,
                   'i' || CAST(c.c_custkey AS STRING) ||
                     CASE c.c_custkey % 5 WHEN 0 THEN '_Fema' WHEN 1 THEN '_Ma'
                          ELSE '_S' || CAST(c.c_custkey % 5 AS STRING) END AS individual,
                   'V' || CAST(l.l_suppkey AS STRING) AS round_id,
                   'L0' || CAST(l.l_linenumber AS STRING) AS lane,
                   CAST(floor(l.l_extendedprice) AS BIGINT) * 1000 AS bytes,
                   CAST(l.l_partkey % 200 AS DOUBLE) / 4 AS coverage
            FROM lineitem l
            JOIN orders o ON o.o_orderkey = l.l_orderkey
            JOIN customer c ON c.c_custkey = o.o_custkey
            JOIN nation n ON n.n_nationkey = c.c_nationkey
            JOIN region r ON r.r_regionkey = n.n_regionkey""",
        # --- expression, hits ----------------------------------------------------------------
        "expr": """
            SELECT 'g' || CAST(l_partkey AS STRING) AS gene, 's' || CAST(l_suppkey % 10 AS STRING) AS sample,
                   CAST(max(CASE WHEN p_size % 10 = 0 THEN 0 ELSE p_size * 100 END) AS BIGINT) AS length,
                   CAST(sum(l_quantity) AS BIGINT) AS count
            FROM lineitem JOIN part ON p_partkey = l_partkey
            GROUP BY l_partkey, l_suppkey % 10""",
        "gene_set": """
            SELECT 'g' || CAST(p_partkey AS STRING) AS gene FROM part WHERE p_type = 'ECONOMY'""",
        "hits": """
            SELECT 'sp|A' || CAST(l_partkey AS STRING) || '|' || 'GENE' || CAST(l_partkey % 400 AS STRING)
                     || CASE WHEN l_partkey % 3 = 0 THEN '' ELSE '_HUMAN' END AS qseqid,
                   'm' || CAST(l_suppkey AS STRING) || '.t' || CAST(l_linenumber AS STRING) AS sseqid,
                   CAST(20 + l_quantity AS DOUBLE) AS pident,
                   l_discount * l_tax / 100 AS evalue,
                   l_extendedprice AS bitscore,
                   CAST(1 + l_orderkey % 30 AS INT) AS qstart,
                   CAST(60 + l_partkey % 140 AS INT) AS qend,
                   CAST(200 AS INT) AS qlen, l_orderkey AS hit_order, l_linenumber AS hit_line
            FROM lineitem""",
        # --- kinship pairs, replicates ------------------------------------------------------
        "kin_pairs": """
            SELECT CASE WHEN o_orderkey % 2 = 0 THEN a ELSE b END AS id1,
                   CASE WHEN o_orderkey % 2 = 0 THEN b ELSE a END AS id2,
                   CAST(o_custkey AS BIGINT) AS n_snp,
                   CASE WHEN o_orderkey % 17 = 0 THEN NULL ELSE CAST(o_custkey % 50 AS DOUBLE) / 100 END AS kinship,
                   CAST(o_orderkey % 10 AS DOUBLE) / 1000 AS ibs0, o_orderkey
            FROM (SELECT o_orderkey, o_custkey,
                    'SP_family' || CAST(o_custkey % 5 AS STRING) || '_' ||
                      CASE o_orderkey % 4 WHEN 0 THEN 'F' WHEN 1 THEN 'M' ELSE 'S' || CAST(o_orderkey % 4 AS STRING) END
                      || '_' || CAST(o_orderkey AS STRING) AS a,
                    'SP_family' || CAST(o_orderkey % 5 AS STRING) || '_' ||
                      CASE o_custkey % 4 WHEN 0 THEN 'F' WHEN 1 THEN 'X' ELSE 'S' || CAST(o_custkey % 4 AS STRING) END
                      || '_' || CAST(o_orderkey AS STRING) AS b
                  FROM orders) x""",
        "kin_lines": """
            SELECT CASE WHEN k % 2 = 0 THEN b ELSE a END AS id1, CASE WHEN k % 2 = 0 THEN a ELSE b END AS id2, z0
            FROM (SELECT l_orderkey AS k, CAST(count(*) AS DOUBLE) / 1000 AS z0,
                    'SP_family' || CAST(min(l_suppkey) % 5 AS STRING) || '_' ||
                      CASE l_orderkey % 4 WHEN 0 THEN 'F' WHEN 1 THEN 'M' ELSE 'S' || CAST(l_orderkey % 4 AS STRING) END
                      || '_' || CAST(l_orderkey AS STRING) AS a,
                    'SP_family' || CAST(l_orderkey % 5 AS STRING) || '_' ||
                      CASE min(l_suppkey) % 4 WHEN 0 THEN 'F' WHEN 1 THEN 'X' ELSE 'S' || CAST(min(l_suppkey) % 4 AS STRING) END
                      || '_' || CAST(l_orderkey AS STRING) AS b
                  FROM lineitem GROUP BY l_orderkey) x""",
        "branch_reps": """
            SELECT CAST(l_orderkey AS BIGINT) AS replicate,
                   CASE l_linenumber % 3 WHEN 0 THEN 'A_B' WHEN 1 THEN 'A_C' ELSE 'B_C' END AS pair,
                   avg(l_extendedprice / 100000) AS ds, avg(l_discount) AS dn,
                   avg(CASE WHEN l_discount > 0.08 THEN NULL ELSE l_tax END) AS dnds
            FROM lineitem
            GROUP BY l_orderkey, CASE l_linenumber % 3 WHEN 0 THEN 'A_B' WHEN 1 THEN 'A_C' ELSE 'B_C' END""",
        # --- strata of 2x2 tables --------------------------------------------------------------
        "cells": """
            SELECT 'k' || CAST(l_suppkey % 40 AS STRING) AS test_key,
                   'h' || CAST(l_orderkey % 5 AS STRING) AS stratum,
                   CAST(sum(CASE WHEN l_returnflag = 'A' AND l_linestatus = 'O' THEN 1 ELSE 0 END) AS BIGINT) AS a,
                   CAST(sum(CASE WHEN l_returnflag = 'A' AND l_linestatus <> 'O' THEN 1 ELSE 0 END) AS BIGINT) AS b,
                   CAST(sum(CASE WHEN l_returnflag <> 'A' AND l_linestatus = 'O' THEN 1 ELSE 0 END) AS BIGINT) AS c,
                   CAST(sum(CASE WHEN l_returnflag <> 'A' AND l_linestatus <> 'O' THEN 1 ELSE 0 END) AS BIGINT) AS d
            FROM lineitem GROUP BY l_suppkey % 40, l_orderkey % 5""",
        # --- alignments: reads of 64 bases ---------------------------------------------------
        "reads": f"""
            SELECT 'r' || CAST(l_orderkey AS STRING) || '_' || CAST(l_linenumber AS STRING) || '_'
                     || CAST(l_partkey AS STRING) || '_' || CAST(l_suppkey AS STRING) AS read_name,
                   'c_' || CAST(l_suppkey % 12 + 1 AS STRING) AS chrom,
                   CAST(l_partkey * 3 + 1 AS BIGINT) AS pos,
                   translate(md5(CAST(l_partkey AS STRING)) || md5(CAST(l_orderkey AS STRING)), {_CLEAN_HEX}) AS seq,
                   CAST(l_linenumber * 10 AS INT) AS mapq,
                   CAST(l_orderkey % 8 AS INT) AS flags,
                   CAST(5 + l_suppkey % 40 AS INT) AS base_quality
            FROM lineitem""",
        # the same reads with gaps: insertions, deletions, skips, clips, padding
        "gapped_reads": """
            SELECT read_name, chrom, pos, seq, base_quality,
                   CASE CAST(pos % 7 AS INT) WHEN 0 THEN '64M' WHEN 1 THEN '10S54M' WHEN 2 THEN '20M4D44M'
                     WHEN 3 THEN '5H20M5I39M3H' WHEN 4 THEN '10M100N30M2P4I20=' WHEN 5 THEN '3S1M1I1D1X20N50M8S' ELSE '*' END AS cigar
            FROM reads""",
    }


DEPENDS = {
    "mean_depth": ["calls"],
    "sex": ["samples"],
    "trios": ["samples"],
    "o_wide": ["calls", "trios"],
    "o_ok": ["calls", "mean_depth"],
    "o_callable": ["o_ok", "trios"],
    "callable_bp": ["dnm"],
    "trinuc": ["dnm"],
    "group_members": ["species_dim"],
    "gapped_reads": ["reads"],
}


# Intermediate steps used by oracle queries only.
ORACLE_VIEWS = {
    "o_wide": """
        SELECT c.chrom, c.pos, c.ref, c.alt, c.filter, t.family, t.father, t.mother, t.child,
               f.gt AS f_gt, m.gt AS m_gt, c.gt AS c_gt, f.dp AS f_dp, m.dp AS m_dp, c.dp AS c_dp,
               f.ref_dp AS f_ref_dp, m.ref_dp AS m_ref_dp, c.ref_dp AS c_ref_dp,
               f.alt_dp AS f_alt_dp, m.alt_dp AS m_alt_dp, c.alt_dp AS c_alt_dp
        FROM calls c JOIN trios t ON t.child = c.sample
        JOIN calls f ON f.sample = t.father AND f.chrom = c.chrom AND f.pos = c.pos
        JOIN calls m ON m.sample = t.mother AND m.chrom = c.chrom AND m.pos = c.pos""",
    "o_ok": """
        SELECT c.* FROM calls c JOIN mean_depth d ON d.sample = c.sample AND d.chrom = c.chrom
        WHERE c.filter = 'PASS' AND c.dp >= 0.5 * d.mean_depth AND c.dp <= 2 * d.mean_depth
          AND c.gq >= 60""",
    "o_callable": """
        SELECT c.chrom, c.pos, c.ref, c.alt, t.family, t.father, t.mother, t.child,
               f.gt AS f_gt, m.gt AS m_gt, c.gt AS c_gt, f.dp AS f_dp, m.dp AS m_dp, c.dp AS c_dp,
               f.ref_dp AS f_ref_dp, m.ref_dp AS m_ref_dp, c.ref_dp AS c_ref_dp,
               f.alt_dp AS f_alt_dp, m.alt_dp AS m_alt_dp, c.alt_dp AS c_alt_dp
        FROM o_ok c JOIN trios t ON t.child = c.sample
        JOIN o_ok f ON f.sample = t.father AND f.chrom = c.chrom AND f.pos = c.pos
        JOIN o_ok m ON m.sample = t.mother AND m.chrom = c.chrom AND m.pos = c.pos""",
}


def closure(names) -> list[str]:
    """Names with their prerequisites, in definition order."""
    wanted: list[str] = []

    def add(name: str) -> None:
        for d in DEPENDS.get(name, []):
            add(d)
        if name not in wanted:
            wanted.append(name)

    for n in names:
        add(n)
    return wanted


class Tables:
    """Lazy access to base tables and views as DataFrames: ``t.lineitem``, ``t.calls``."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir
        self._cache: dict[str, DataFrame] = {}

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        if name not in self._cache:
            if name in BASE:
                self._cache[name] = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
            else:
                self._cache[name] = self.sql(view_sql("spark")[name])
        return self._cache[name]

    def sql(self, text: str) -> DataFrame:
        """Run SQL that names base tables or views; names become DataFrame arguments."""
        import re

        used = [
            n
            for n in [*BASE, *view_sql("spark")]
            if re.search(rf"\b(FROM|JOIN)\s+{n}\b", text)
        ]
        for n in used:
            text = re.sub(rf"\b(FROM|JOIN)\s+{n}\b", rf"\1 {{{n}}}", text)
        return self.spark.sql(text, **{n: getattr(self, n) for n in used})


def oracle_text(sql: str) -> str:
    """Prefix an oracle query with the views it names, as common table expressions."""
    import re

    views = {**view_sql("duck"), **ORACLE_VIEWS}
    used = closure(n for n in views if re.search(rf"\b(FROM|JOIN)\s+{n}\b", sql))
    ctes = ",\n".join(f"{n} AS ({views[n]})" for n in used)
    body = sql.strip()
    if not ctes:
        return body
    recursive = body.upper().startswith("WITH RECURSIVE")
    if body.upper().startswith("WITH"):
        rest = body[len("WITH RECURSIVE") :] if recursive else body[len("WITH") :]
        return f"WITH {'RECURSIVE ' if recursive else ''}{ctes},\n{rest.strip()}"
    return f"WITH {ctes}\n{body}"
