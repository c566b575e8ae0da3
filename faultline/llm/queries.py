"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import centroids, exact_dedup, langid, lm_score, media, mixing, packing, repair, sharding, simhash, substring, token_files, toxicity


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.repeats(_docs(spark, sf_dir))


def op2_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_score.score(_docs(spark, sf_dir))


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(_docs(spark, sf_dir))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(_docs(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op5_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_docs(spark, sf_dir))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(_docs(spark, sf_dir))


def op7_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(_docs(spark, sf_dir))


def op8_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media_digest(_docs(spark, sf_dir))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_groups(_docs(spark, sf_dir))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_docs(spark, sf_dir))


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.repair(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


def op12_token_ids(spark: SparkSession, sf_dir: str, tokenizer: str = "word_bpe_49k.json") -> DataFrame:
    import public_tokenizers

    return token_files.token_digest(_docs(spark, sf_dir), public_tokenizers.path(tokenizer))


def op13_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.cluster(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_substring_dedup, op2_lm_score, op3_exact_dedup, op4_toxicity, op5_mix_sources, op6_language_id, op7_shard, op8_media, op9_simhash, op10_packing, op11_conversation_repair, op12_token_ids, op13_centroids)
}

def _crc_sql(hexed: str) -> str:
    """crc32 of the bytes that ``hexed`` spells, over the usual table of its polynomial."""
    table = []
    for i in range(256):
        for _ in range(8):
            i = i >> 1 ^ (0xEDB88320 if i & 1 else 0)
        table.append(i)
    step = f"lambda c, b: xor(c >> 8, {table}[CAST(xor(c, b) & 255 AS INT) + 1])"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(regexp_extract_all({hexed}, '..'), lambda x: CAST('0x' || x AS BIGINT))), {step}), 4294967295::BIGINT)"


def _xxh64_sql(values: str, size: str, seed: int = 42) -> str:
    """XXH64 of a list of ``size`` byte values, in 128-bit numbers modulo 2**64."""
    p = [f"{x}::UHUGEINT" for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5)]
    cut = lambda x: f"(({x}) % 18446744073709551616::UHUGEINT)"
    turn = lambda x, r: f"({cut(f'({x}) * {1 << r}::UHUGEINT')} + ({x}) // {1 << 64 - r}::UHUGEINT)"
    lane = lambda o, n: "(" + " + ".join(f"{values}[{o} + {k + 1}] * {256**k}::UHUGEINT" for k in range(n)) + ")"
    round_ = lambda acc, x: cut(f"{turn(cut(f'{acc} + {cut(f"{x} * {p[1]}")}'), 31)} * {p[0]}")
    fold = lambda start, items, step: f"list_reduce(list_prepend({start}, {items}), lambda h, x: {step})"
    whole, mod = f"({size} // 32)", 1 << 64
    starts = [(seed + int(a) * 0x9E3779B185EBCA87 + int(b) * 0xC2B2AE3D27D4EB4F) % mod for a, b in ((1, 1), (0, 1), (0, 0), (-1, 0))]
    accs = [fold(f"{s}::UHUGEINT", f"[{lane(f'32 * i + {8 * j}', 8)} FOR i IN range({whole})]", round_("h", "x")) for j, s in enumerate(starts)]
    return f"""(SELECT CAST(h AS UBIGINT) FROM (SELECT {cut(f"xor(h, h // {1 << 32}::UHUGEINT)")} AS h FROM (SELECT {cut(f"xor(h, h // {1 << 29}::UHUGEINT) * {p[2]}")} AS h FROM (SELECT {cut(f"xor(h, h // {1 << 33}::UHUGEINT) * {p[1]}")} AS h FROM (
        SELECT {fold("h", f"[{values}[{size} - {size} % 4 + i + 1] FOR i IN range({size} % 4)]", cut(f"{turn(f'xor(h, {cut(f"x * {p[4]}")})', 11)} * {p[0]}"))} AS h FROM (
        SELECT {fold("h", f"[{lane(f'({size} - {size} % 8)', 4)} FOR i IN range({size} % 8 // 4)]", cut(f"{turn(f'xor(h, {cut(f"x * {p[0]}")})', 23)} * {p[1]} + {p[2]}"))} AS h FROM (
        SELECT {fold("h", f"[{lane(f'32 * {whole} + 8 * i', 8)} FOR i IN range({size} % 32 // 8)]", cut(f"{turn(f'xor(h, {round_('0::UHUGEINT', 'x')})', 27)} * {p[0]} + {p[3]}"))} AS h FROM (
        SELECT {cut(f"{size}::UHUGEINT + CASE WHEN {size} < 32 THEN {cut(f'{seed} + {p[4]}')} ELSE list_reduce([{cut(' + '.join(turn(f'a[{j + 1}]', r) for j, r in enumerate((1, 7, 12, 18))))}, a[1], a[2], a[3], a[4]], lambda h, x: {cut(f'xor(h, {round_('0::UHUGEINT', 'x')}) * {p[0]} + {p[3]}')}) END")} AS h
        FROM (SELECT [{", ".join(accs)}] AS a)))))))))"""


def _simhash_sql() -> str:
    """Fingerprints by XXH64 of every shingle, links by all pairs of distinct fingerprints, components by reach."""
    return rf"""WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
    s AS (SELECT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')] ELSE [w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] FOR i IN range(1, len(w) - 1)] END) AS s FROM d),
    u AS (SELECT s, list_transform(regexp_extract_all(hex(encode(s)), '..'), lambda b: CAST('0x' || b AS UHUGEINT)) AS v FROM (SELECT DISTINCT s FROM s)),
    h AS (SELECT s, {_xxh64_sql("v", "len(v)")} AS h FROM u),
    n AS (SELECT doc_id, h, count(*) AS k FROM s JOIN h USING (s) GROUP BY 1, 2),
    b AS (SELECT doc_id, i, sum(k * ((h >> i) & 1)) * 2 > sum(k) AS bit FROM n, (SELECT unnest(range(64))::UBIGINT AS i) GROUP BY 1, 2),
    f AS (SELECT d.doc_id, coalesce(fp, 0::UBIGINT) AS fp FROM d LEFT JOIN (SELECT doc_id, bit_or(CASE WHEN bit THEN CAST(1::UHUGEINT << i::UHUGEINT AS UBIGINT) ELSE 0::UBIGINT END) AS fp FROM b GROUP BY 1) USING (doc_id)),
    p AS (SELECT fp, min(doc_id) AS least FROM f GROUP BY 1),
    e AS (SELECT x.fp AS a, y.fp AS b FROM p x JOIN p y ON x.fp <> y.fp AND bit_count(xor(x.fp, y.fp)) <= 3),
    r(a, b) AS (SELECT fp, fp FROM p UNION SELECT r.a, e.b FROM r JOIN e ON e.a = r.b)
    SELECT f.doc_id, printf('%016x', fp) AS fingerprint, component_id FROM f JOIN (SELECT a, min(least) AS component_id FROM r JOIN p ON p.fp = r.b GROUP BY 1) ON a = fp"""


def _sharding_sql(shards: int = 16, levels: int = 4) -> str:
    """The k-d tree with exact medians, level by level."""
    scaled = lambda v: f"CAST(least(floor({v} * 16777216), 16777215) AS BIGINT) * 68719476736 + tie"
    parts = [f"""d AS (SELECT doc_id, source, lang, coalesce(text, '') AS t, strlen(coalesce(text, '')) + 1 AS size FROM documents),
    rs AS (SELECT source, (row_number() OVER (ORDER BY source) - 1) / (count(*) OVER ())::DOUBLE AS r FROM (SELECT DISTINCT source FROM d WHERE source IS NOT NULL)),
    rl AS (SELECT lang, (row_number() OVER (ORDER BY lang) - 1) / (count(*) OVER ())::DOUBLE AS r FROM (SELECT DISTINCT lang FROM d WHERE lang IS NOT NULL)),
    g AS (SELECT t, CAST(sum(size) AS BIGINT) AS w, min(source) AS source, min(lang) AS lang, max(size) AS most, CAST('0x' || substr(md5(t), 1, 9) AS BIGINT) AS tie FROM d GROUP BY t),
    a AS (SELECT t, w, {scaled("coalesce(rs.r, 0)")} AS d0, {scaled("coalesce(rl.r, 0)")} AS d1, {scaled("least(round(log2(most + 1) / 40, 9), 0.9999999)")} AS d2,
        row_number() OVER (ORDER BY w DESC, tie) AS heavy, sum(w) OVER (ORDER BY w DESC, tie) AS top, sum(w) OVER () AS total FROM g LEFT JOIN rs USING (source) LEFT JOIN rl USING (lang)),
    k AS (SELECT k, least({shards - 1}, (SELECT count(*) FROM a WHERE w > (total - coalesce((SELECT top FROM a b WHERE b.heavy = k), 0)) / ({shards} - k)::DOUBLE)) AS more FROM range({shards}) r(k)),
    own(n) AS (SELECT 0::BIGINT UNION SELECT greatest(own.n, k.more) FROM own JOIN k ON k.k = own.n),
    alone AS (SELECT max(n) AS n FROM own),
    l0 AS (SELECT t, w, d0, d1, d2, 0::BIGINT AS first, {shards} - n AS shards, max(d0) OVER () + 1 - min(d0) OVER () AS w0, max(d1) OVER () + 1 - min(d1) OVER () AS w1, max(d2) OVER () + 1 - min(d2) OVER () AS w2 FROM a, alone WHERE heavy > n)"""]
    for i in range(levels):
        width = lambda k: f"(max(d{k}) OVER f + 1 - min(d{k}) OVER f)::DOUBLE / w{k}"
        parts.append(f"""x{i} AS (SELECT *, {width(0)} AS s0, {width(1)} AS s1, {width(2)} AS s2 FROM l{i} WINDOW f AS (PARTITION BY first)),
    y{i} AS (SELECT *, CASE WHEN s0 >= s1 AND s0 >= s2 THEN d0 WHEN s1 >= s2 THEN d1 ELSE d2 END AS v FROM x{i}),
    z{i} AS (SELECT *, sum(w) OVER (PARTITION BY first ORDER BY v) AS upto, (sum(w) OVER (PARTITION BY first) * (shards // 2))::DOUBLE / shards AS goal FROM y{i}),
    c{i} AS (SELECT first AS f, arg_min(CASE WHEN abs(upto - w - goal) <= abs(upto - goal) THEN v ELSE v + 1 END, v) AS cut FROM z{i} WHERE upto >= goal GROUP BY first),
    l{i + 1} AS (SELECT t, w, d0, d1, d2, CASE WHEN shards > 1 AND v >= cut THEN first + shards // 2 ELSE first END AS first, CASE WHEN shards <= 1 THEN shards WHEN v >= cut THEN shards - shards // 2 ELSE shards // 2 END AS shards, w0, w1, w2
        FROM y{i} JOIN c{i} ON f = first)""")
    return "WITH RECURSIVE " + ",\n    ".join(parts) + f""",
    placed AS (SELECT t, first AS shard FROM l{levels} UNION ALL SELECT t, {shards} - n + heavy - 1 FROM a, alone WHERE heavy <= n)
    SELECT doc_id, CAST(size AS BIGINT) AS size, {_crc_sql("hex(encode(t))")} AS text_crc32, 'bytes' AS law, CAST(shard AS INT) AS shard, CAST(row_number() OVER (PARTITION BY shard ORDER BY doc_id NULLS FIRST) - 1 AS BIGINT) AS slot, CAST(NULL AS INT) AS grown_shard
    FROM d JOIN placed USING (t)"""


def _media_sql() -> str:
    """The container spelled out in hexadecimal, box by box; ``n`` bytes of payload in ``m`` samples, ``q`` of them key frames."""
    u32 = lambda x: f"printf('%08x', CAST({x} AS BIGINT))"
    spell = lambda b: f"'{b.hex()}'"

    def box(kind: bytes, *parts: str) -> str:
        body = " || ".join(parts) or "''"
        return f"(SELECT {u32('8 + length(body) // 2')} || {spell(kind)} || body FROM (SELECT {body} AS body))"

    full = lambda kind, *parts, flags=0: box(kind, spell(bytes([0, 0, 0, flags])), *parts)
    n32 = u32("least(n, 4294967295)")
    head = [spell(bytes(8) + media.RATE.to_bytes(4, "big")), n32]
    entry = box(b"raw ", spell(bytes(6) + b"\0\1" + bytes(8) + b"\0\1\0\x08" + bytes(4) + (media.RATE << 16).to_bytes(4, "big")))
    whole, rest = f"n // {media.BLOCK}", f"n % {media.BLOCK}"
    times = f"CASE WHEN {whole} > 0 THEN {u32(whole)} || {u32(media.BLOCK)} ELSE '' END || CASE WHEN {rest} > 0 THEN '00000001' || {u32(rest)} ELSE '' END"
    sizes = f"repeat({u32(media.BLOCK)}, {whole}) || CASE WHEN {rest} > 0 THEN {u32(rest)} ELSE '' END"
    keys = f"array_to_string(list_transform(range(0, m, {media.KEY_EVERY}), lambda i: {u32('i + 1')}), '')"
    tables = box(
        b"stbl", full(b"stsd", "'00000001'", entry), full(b"stts", u32(f"({whole} > 0)::INT + ({rest} > 0)::INT"), f"({times})"), full(b"stss", u32("q"), keys), full(b"stsc", "'0000000100000001'", u32("greatest(m, 1)"), "'00000001'"),
        full(b"stsz", "'00000000'", u32("m"), f"({sizes})"), full(b"co64", "'0000000100000000'", u32("pos")),
    )
    matrix = spell(media.MATRIX)
    movie = box(
        b"moov",
        full(b"mvhd", *head, spell(b"\0\1\0\0\1\0" + bytes(10)), matrix, spell(bytes(24) + b"\0\0\0\2")),
        box(
            b"trak",
            full(b"tkhd", spell(bytes(8) + b"\0\0\0\1" + bytes(4)), n32, spell(bytes(12) + b"\1\0\0\0"), matrix, spell(bytes(8)), flags=3),
            box(b"mdia", full(b"mdhd", *head, "'55c40000'"), full(b"hdlr", spell(bytes(4) + b"soun" + bytes(13))), box(b"minf", full(b"smhd", "'00000000'"), box(b"dinf", full(b"dref", "'00000001'", full(b"url ", flags=1))), tables)),
        ),
    )
    kind = spell((24).to_bytes(4, "big") + b"ftypisom" + (512).to_bytes(4, "big") + b"isommp41")
    return f"""WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
    p AS (SELECT doc_id, length(h) // 2 AS n_bytes, CASE WHEN h = '' THEN repeat('00', 64) ELSE h || repeat('00', CAST((64 - length(h) // 2 % 64) % 64 AS BIGINT)) END AS payload FROM d),
    s AS (SELECT *, length(payload) // 2 AS n, (length(payload) // 2 + {media.BLOCK - 1}) // {media.BLOCK} AS m FROM p),
    r AS (SELECT *, (m + {media.KEY_EVERY - 1}) // {media.KEY_EVERY} AS q FROM s),
    z AS (SELECT *, 24 + length({movie}) // 2 + 8 AS begins FROM (SELECT *, 0 AS pos FROM r)),
    f AS (SELECT doc_id, n_bytes, payload, n, m, q, begins, {kind} || {movie} || {u32('n + 8')} || {spell(b'mdat')} || payload AS stored FROM (SELECT * EXCLUDE (pos), begins AS pos FROM z)),
    b AS (SELECT doc_id, list_transform(regexp_extract_all(payload, '..'), lambda x: CAST('0x' || x AS INT)) AS v FROM f),
    c AS (SELECT doc_id, v, count(*) AS k FROM (SELECT doc_id, unnest(v) AS v FROM b) GROUP BY 1, 2),
    e AS (SELECT doc_id, sum(k) AS total, sum(v * k) AS level FROM c GROUP BY 1),
    t AS (SELECT c.doc_id, first(level) / first(total)::DOUBLE AS mean, -sum(k / total::DOUBLE * log2(k / total::DOUBLE)) AS entropy FROM c JOIN e USING (doc_id) GROUP BY 1),
    j AS (SELECT doc_id, len(list_filter(list_zip(v[:-2], v[2:]), lambda x: x[1] <> x[2])) AS jumps FROM b)
    SELECT doc_id, CAST(n_bytes AS BIGINT) AS n_bytes, CAST(n AS BIGINT) AS payload_bytes, sha256(unhex(payload)) AS payload_sha256, {_crc_sql("right(payload, 128)")} AS tail_crc32, CAST(length(stored) // 2 AS BIGINT) AS media_bytes,
        sha256(unhex(stored)) AS media_sha256, printf('raw;rate={media.RATE};seconds=%.3f;samples=%d;keys=%d;mean=%.4f;entropy=%.6f;changes=%d', n / {media.RATE}::DOUBLE, CAST(m AS BIGINT), CAST(q AS BIGINT), mean, entropy, CAST(jumps AS BIGINT)) AS feature,
        'raw' AS codec, n / {media.RATE}::DOUBLE AS duration, list_transform(range(0, m, {media.KEY_EVERY}), lambda i: CAST(begins + i * {media.BLOCK} AS BIGINT)) AS key_offsets,
        list_transform(range(0, m, {media.KEY_EVERY}), lambda i: CAST(least({media.BLOCK}, n - i * {media.BLOCK}) AS BIGINT)) AS key_lengths
    FROM f JOIN t USING (doc_id) JOIN j USING (doc_id)"""


def _repair_sql() -> str:
    """The edit lattice as a fold over each conversation's rows: per grammar state the least cost (six digits) and audit."""
    add = lambda k, cost, letter: f"CASE WHEN {k} = 'Z' THEN 'Z' ELSE printf('%06d', CAST(substr({k}, 1, 6) AS BIGINT) + {cost}) || substr({k}, 7) || '{letter}' END"
    row = lambda k, cost, letter: add(k, f"{cost} + CASE WHEN c[1] = upper(c[1]) THEN 5 ELSE 0 END", letter)
    kept = lambda k, role: f"CASE WHEN lower(c[1]) = '{role}' THEN {row(k, 0, 'K')} ELSE 'Z' END"
    new = lambda k: f"CASE WHEN c[1] = '-' THEN 'Z' ELSE {row(k, 1, 'R')} END"
    gone = [add(f"s[{q}]", 2, "D") for q in (1, 2, 3, 4)]
    into_u = ", ".join(f"{kept(f's[{q}]', 'u')}, {new(f's[{q}]')}" for q in (1, 2, 4))
    moved = f"[{gone[0]}, least({gone[1]}, {kept('s[1]', 's')}), least({gone[2]}, {into_u}), least({gone[3]}, {kept('s[3]', 'a')}, {new('s[3]')})]"
    to_u = f"least(n[3], {', '.join(add(f'n[{q}]', 5, 'I') for q in (1, 2, 4))})"
    closed = f"list_transform(list_transform([{moved}], lambda n: [n[1], n[2], {to_u}, n[4]]), lambda n: [n[1], n[2], n[3], least(n[4], {add('n[3]', 5, 'I')})])[1]"
    crc = _crc_sql("hex(encode(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ')))")
    return rf"""WITH h AS (SELECT coalesce('=' || conv_id, '-') AS g, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {crc} % 20 AS hit FROM conversations),
    d AS (SELECT g, turn, CASE WHEN hit = 4 THEN 'user' ELSE role END AS role, CASE hit WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(CASE WHEN hit = 3 THEN [1, 2] ELSE [1] END) FROM h WHERE hit <> 0),
    p AS (SELECT g, turn, role, text, CASE WHEN role[1] IN ('s', 'u', 'a') THEN role[1] ELSE 'x' END AS ini, regexp_extract(text, '([^\x20\x09-\x0D])[\x20\x09-\x0D]*$', 1) AS tail,
        row_number() OVER (PARTITION BY g ORDER BY turn NULLS FIRST, role, sha256(text)) AS pos FROM d),
    o AS (SELECT *, row_number() OVER (PARTITION BY g, role, text ORDER BY pos) AS nth FROM p),
    f AS (SELECT *, CASE WHEN tail = '' THEN 'blank' WHEN nth > 1 THEN 'duplicate' WHEN tail NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault, ini || lead(ini) OVER (PARTITION BY g ORDER BY pos) AS pair FROM o),
    c AS (SELECT g, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
        count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal, list([CASE WHEN fault IN ('blank', 'duplicate') THEN '-' WHEN fault = 'truncated' THEN upper(ini) ELSE ini END] ORDER BY pos) AS codes FROM f GROUP BY 1),
    s AS (SELECT *, list_reduce(list_prepend(['000000', 'Z', '000005I', '000010II'], codes), lambda s, c: {closed}) AS s FROM c),
    b AS (SELECT *, CAST(substr(least(s[1], s[4]), 1, 6) AS BIGINT) AS cost, substr(least(s[1], s[4]), 7) AS audit FROM s),
    e AS (SELECT g, i, audit[i] AS letter, length(replace(audit[1:i], 'I', '')) AS pos FROM (SELECT g, audit, unnest(range(1, len(audit) + 1)) AS i FROM b) WHERE audit[i] <> 'D'),
    k AS (SELECT e.*, f.role, f.text, f.ini, row_number() OVER (PARTITION BY e.g ORDER BY i) - 1 AS k FROM e LEFT JOIN f ON f.g = e.g AND f.pos = e.pos),
    l AS (SELECT *, max(CASE WHEN k = 0 AND letter = 'K' AND ini = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY g) AS led FROM k),
    r AS (SELECT g, string_agg(CASE WHEN letter = 'K' THEN role WHEN (k - led) % 2 = 0 THEN 'user' ELSE 'assistant' END || ':' || CASE WHEN letter = 'I' THEN '' ELSE text END, chr(10) ORDER BY k) AS t FROM l GROUP BY 1)
    SELECT conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(cost, 0) AS cost, coalesce(audit, '') AS audit,
        sha256(coalesce(t, '')) AS repaired_sha256 FROM (SELECT DISTINCT conv_id FROM conversations) a LEFT JOIN b ON b.g = coalesce('=' || a.conv_id, '-') LEFT JOIN r ON r.g = b.g"""


def _centroids_sql(clusters: int = 8, rounds: int = 10) -> str:
    """Every round of assigning and moving, one after the other."""
    gap = "list_sum(list_transform(range(1, 65), lambda j: (v.e[j] - c.e[j]) * (v.e[j] - c.e[j])))"
    parts = [f"""v AS (SELECT row_number() OVER () AS i, vec_id, embedding AS raw, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
        FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64),
    c0 AS (SELECT CAST(row_number() OVER (ORDER BY sha256('3:' || coalesce(CAST(vec_id AS VARCHAR), '')), raw) - 1 AS INT) AS k, e FROM v QUALIFY k < {clusters})"""]
    for r in range(rounds + 1):
        parts.append(f"a{r} AS (SELECT i, min({{'d': CAST({gap} AS BIGINT), 'k': c.k}}) AS b FROM v, c{r} c GROUP BY i)")
        if r < rounds:
            parts.append(f"""s{r} AS (SELECT k, j, sum(x) AS s, count(*) AS n FROM (SELECT b.k AS k, unnest(range(1, 65)) AS j, unnest(e) AS x FROM a{r} JOIN v USING (i)) GROUP BY 1, 2),
    c{r + 1} AS (SELECT c{r}.k, coalesce(any_value(m.e), any_value(c{r}.e)) AS e FROM c{r} LEFT JOIN (SELECT k, list(CAST((s - (s % n + n) % n) // n AS BIGINT) ORDER BY j) AS e FROM s{r} GROUP BY k) m USING (k) GROUP BY c{r}.k)""")
    return "WITH " + ",\n    ".join(parts) + f"""
    SELECT vec_id, b.k AS cluster, b.d AS distance, CAST(sum(b.d) OVER (PARTITION BY b.k) AS BIGINT) AS cluster_inertia, CAST(sum(b.d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c.e, ',')) AS centroid_sha256
    FROM a{rounds} JOIN v USING (i) JOIN c{rounds} c ON c.k = b.k"""


ORACLE_SQL: dict[str, str] = {
    "op3_exact_dedup": r"""
        WITH d AS (
            SELECT doc_id, coalesce(text, '') AS t,
                   regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS n
            FROM documents
        ), g AS (
            SELECT doc_id, n, count(*) OVER (PARTITION BY n) AS group_size,
                   first_value(doc_id) OVER (PARTITION BY n ORDER BY length(t) DESC, doc_id) AS keep_id
            FROM d
        )
        SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(n) AS text_sha256 FROM g
    """,
    "op5_mix_sources": r"""
        WITH RECURSIVE d AS (
            SELECT doc_id, source, coalesce(text, '') AS t, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size FROM documents
        ), k AS (
            SELECT doc_id, source, size, -ln((CAST('0x' || substr(md5('11:' || doc_id), 1, 13) AS BIGINT) + 0.5) / 4503599627370496.0)
                / (exp(-abs(length(t) / greatest(size, 1) - 6.5) / 6.5) * 0.95 + 0.05) AS key
            FROM d
        ), g AS (
            SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source
        ), w AS (
            SELECT *, [5.0::DOUBLE, 2.0::DOUBLE, 1.0::DOUBLE][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS w, 3.0::DOUBLE * source_size AS cap FROM g
        ), o AS (
            SELECT *, row_number() OVER (ORDER BY cap / w, source NULLS LAST) AS rank,
                (sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
                / sum(w) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS line FROM w
        ), f AS (
            SELECT *, first_value(line) OVER (ORDER BY CASE WHEN cap / w >= line THEN rank END NULLS LAST) AS final FROM o
        ), goal AS (
            SELECT source, source_size, coalesce(least(cap, w * final), cap) AS target FROM f
        ), e AS (
            SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size + 1e-9) ELSE 0 END AS epochs FROM goal
        ), r AS (
            SELECT k.doc_id, k.source, k.size, row_number() OVER (PARTITION BY k.source ORDER BY k.key, k.size) AS i, greatest(0, round(target - epochs * source_size, 6)) AS room
            FROM k JOIN e ON k.source IS NOT DISTINCT FROM e.source WHERE k.size > 0
        ), walk(source, i, doc_id, took, room) AS (
            SELECT source, i, doc_id, size <= room, CASE WHEN size <= room THEN room - size ELSE room END FROM r WHERE i = 1
            UNION ALL
            SELECT r.source, r.i, r.doc_id, r.size <= walk.room, CASE WHEN r.size <= walk.room THEN walk.room - r.size ELSE walk.room END
            FROM walk JOIN r ON r.source IS NOT DISTINCT FROM walk.source AND r.i = walk.i + 1
        )
        SELECT k.doc_id, k.source, CAST(k.size AS BIGINT) AS size, e.source_size, e.target, CAST(k.size * (e.epochs + CASE WHEN walk.took THEN 1 ELSE 0 END) AS BIGINT) AS taken
        FROM k JOIN e ON k.source IS NOT DISTINCT FROM e.source LEFT JOIN walk ON walk.doc_id = k.doc_id AND walk.source IS NOT DISTINCT FROM k.source
    """,
    "op10_packing": r"""
        WITH RECURSIVE d AS (
            SELECT doc_id, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) + 1 AS n FROM documents
        ), p AS (
            SELECT doc_id, unnest(range(0, (n - 1) // 2048 + 1)) AS piece, n FROM d
        ), cut AS (
            SELECT doc_id, piece, piece * 2048 AS start, least(n - piece * 2048, 2048) AS n_tokens FROM p
        ), h AS (
            SELECT row_number() OVER (ORDER BY n_tokens) AS j, n_tokens AS len, sum(count(*)) OVER (ORDER BY n_tokens) AS n, sum(count(*) * n_tokens) OVER (ORDER BY n_tokens) AS t FROM cut GROUP BY n_tokens
        ), k AS (
            SELECT j, len, CAST(n AS BIGINT) AS n, CAST(t AS BIGINT) AS t FROM h UNION ALL SELECT 0, 0, 0, 0
        ), dp(step, j, cost, came) AS (
            SELECT 0, CAST(0 AS BIGINT), CAST(0 AS BIGINT), CAST(0 AS BIGINT)
            UNION ALL
            SELECT * FROM (
                SELECT a.step + 1, y.j, min(a.cost + y.len * (y.n - x.n) - (y.t - x.t)), arg_min(x.j, (a.cost + y.len * (y.n - x.n) - (y.t - x.t), x.j))
                FROM dp a JOIN k x ON x.j = a.j JOIN k y ON y.j > x.j WHERE a.step < 12 GROUP BY a.step, y.j)
        ), best AS (
            SELECT least(12, max(j)) AS steps, max(j) AS m FROM k
        ), back(step, j) AS (
            SELECT steps, m FROM best WHERE m > 0
            UNION ALL
            SELECT back.step - 1, dp.came FROM back JOIN dp ON dp.step = back.step AND dp.j = back.j WHERE back.step > 1
        ), edges AS (
            SELECT row_number() OVER (ORDER BY len) - 1 AS bucket, len, coalesce(lag(len) OVER (ORDER BY len), 0) AS low FROM back JOIN k USING (j)
        ), placed AS (
            SELECT doc_id, piece, start, n_tokens, bucket, len, 16384 // len AS per, row_number() OVER (PARTITION BY bucket ORDER BY doc_id NULLS FIRST, piece) - 1 AS slot
            FROM cut JOIN edges ON n_tokens > low AND n_tokens <= len
        )
        SELECT doc_id, CAST(piece AS BIGINT) AS piece, CAST(start AS BIGINT) AS start, CAST(n_tokens AS BIGINT) AS n_tokens, CAST(bucket AS INT) AS bucket, CAST(len AS BIGINT) AS padded_len,
            CAST(slot // per AS BIGINT) AS batch_id, CAST(slot % per AS BIGINT) AS position
        FROM placed
    """,
    "op7_shard": _sharding_sql(),
    "op8_media": _media_sql(),
    "op9_simhash": _simhash_sql(),
    "op11_conversation_repair": _repair_sql(),
    "op13_centroids": _centroids_sql(),
}
