"""DuckDB SQL of the queries."""

from __future__ import annotations

_EXACT = """
s AS (SELECT doc_id AS idx, n_chars AS byte_size, sha256(text) AS content_hash FROM documents),
c AS (SELECT s.* FROM s WHERE byte_size IN (SELECT byte_size FROM s GROUP BY 1 HAVING count(*) > 1)),
x AS (SELECT content_hash, min(idx) AS rep, count(*) AS files, CAST(sum(byte_size) - max(byte_size) AS BIGINT) AS reclaimable, list_sort(list(idx)) AS members
      FROM c WHERE content_hash IS NOT NULL GROUP BY 1 HAVING count(*) > 1)
"""

_FRAMES = r"""
w AS (SELECT doc_id AS idx, string_split_regex(text, '\s+') AS w FROM documents),
fr AS (SELECT idx, pos, CAST('0x' || substr(md5(w[pos + 1] || ' ' || w[pos + 2] || ' ' || w[pos + 3]), 1, 8) AS BIGINT) AS v
       FROM (SELECT idx, w, unnest(range(0, len(w) - 2)) AS pos FROM w WHERE len(w) >= 3)),
un AS (SELECT idx, count(*) AS n FROM fr GROUP BY 1 HAVING count(*) >= 64)
"""

_INDEX = """
po AS (SELECT fr.idx, pos, unnest([v & 65535, (v >> 16) | 65536]) AS key FROM fr JOIN us ON fr.idx = us.idx WHERE pos % 2 = 0),
bk AS (SELECT key, count(*) AS entries FROM po GROUP BY 1 HAVING count(*) BETWEEN 2 AND 400),
kept AS (SELECT po.* FROM po JOIN bk ON po.key = bk.key),
vt AS (SELECT p.idx AS a, q.idx AS b, p.pos - q.pos AS off, count(*) AS n FROM kept p JOIN kept q ON p.key = q.key AND p.idx < q.idx GROUP BY ALL),
bo AS (SELECT a, b, off, n FROM (SELECT *, row_number() OVER (PARTITION BY a, b ORDER BY n DESC, off) AS rn FROM vt) WHERE rn = 1 AND n >= 6),
al AS (SELECT a, b, off, count(*) AS overlap, CAST(sum(bit_count(xor(x.v, y.v))) AS BIGINT) AS errors
       FROM bo JOIN fr x ON x.idx = a JOIN fr y ON y.idx = b AND y.pos = x.pos - off GROUP BY a, b, off),
ae AS (SELECT al.*, errors / (overlap * 32) AS ber, p.n AS na, q.n AS nb FROM al JOIN us p ON p.idx = a JOIN us q ON q.idx = b)
"""

_ALL = "us AS (SELECT * FROM un)"
_REPS = "us AS (SELECT un.* FROM un WHERE idx NOT IN (SELECT m FROM (SELECT unnest(members) AS m, rep FROM x) WHERE m <> rep))"

#: greatest bit error and overlap of each level
_LEVELS = {
    "perfect": (0.12, "overlap >= greatest(na, nb) * 0.95"),
    "very_strict": (0.12, "overlap >= least(na, nb) * 0.25"),
    "strict": (0.18, "overlap >= least(na, nb) * 0.25"),
    "relaxed": (0.24, "overlap >= least(na, nb) * 0.25"),
    "very_relaxed": (0.30, "overlap >= least(na, nb) * 0.25"),
}


def _edges(level: str, name: str = "ed") -> str:
    most, share = _LEVELS[level]
    return f"{name} AS (SELECT a, b, greatest(0.0, least(1.0, 1 - ber / 0.5)) AS score FROM ae WHERE {share} AND overlap * (512 / 11025) >= 3.0 AND ber <= {most})"


_REACH = """
both_ways AS (SELECT a AS u, b AS v FROM ed UNION SELECT b, a FROM ed),
reach(u, v) AS (SELECT u, u FROM both_ways UNION SELECT r.u, e.v FROM reach r JOIN both_ways e ON r.v = e.u),
comp AS (SELECT u AS idx, min(v) AS component FROM reach GROUP BY 1)
"""

_SIMILAR = f"""
WITH RECURSIVE {_EXACT}, {_FRAMES}, {_REPS}, {_INDEX}, {_edges("very_strict")}, {_REACH},
conf AS (SELECT component, min(score) AS confidence FROM ed JOIN comp ON ed.a = comp.idx GROUP BY 1),
mem AS (SELECT comp.component, coalesce(m.m, comp.idx) AS idx FROM comp LEFT JOIN (SELECT rep, unnest(members) AS m FROM x) m ON m.rep = comp.idx),
ab AS (SELECT * FROM x WHERE rep NOT IN (SELECT idx FROM mem)),
gr AS (
  SELECT 'exact' AS kind, rep, files, reclaimable, CAST(1 AS DOUBLE) AS confidence FROM ab
  UNION ALL
  SELECT 'similar', min(mem.idx), count(*), CAST(sum(byte_size) - max(byte_size) AS BIGINT), min(confidence) FROM mem JOIN s ON s.idx = mem.idx JOIN conf ON conf.component = mem.component GROUP BY mem.component
)
"""

_SHAPES = """
WITH f AS (SELECT vec_id, coalesce(CAST(label AS BIGINT), -1) AS idx, CAST(embedding[1:33] AS DOUBLE[]) AS e FROM embeddings),
g AS (SELECT *, lag(e) OVER (PARTITION BY idx ORDER BY vec_id) AS p FROM f),
ch AS (SELECT idx, list_sum(list_transform(range(1, 34), lambda m: abs(e[m] - p[m]))) / 33 AS change FROM g WHERE p IS NOT NULL),
fx AS (SELECT idx, n, coalesce(s[n // 2 + 1], 3.4028234663852886e38) AS flux FROM (
  SELECT i.idx, count(change) AS n, list_sort(list(change) FILTER (change IS NOT NULL)) AS s FROM (SELECT DISTINCT idx FROM f) i LEFT JOIN ch ON ch.idx = i.idx GROUP BY 1)),
mm AS (SELECT idx, m, avg(e[m]) AS mean FROM (SELECT idx, e, unnest(range(1, 34)) AS m FROM f) GROUP BY 1, 2),
mx AS (SELECT idx, max(mean) AS top FROM mm GROUP BY 1),
sh AS (SELECT mm.idx, list(CAST(round((least(0.0, greatest(-8.0, mean - top)) + 8) / 8 * 255) AS BIGINT) ORDER BY m) AS shape FROM mm JOIN mx ON mm.idx = mx.idx GROUP BY 1)
"""

_SIGNALS = "x AS (SELECT user_id, list(value ORDER BY ts, event_id) AS x FROM events WHERE value IS NOT NULL GROUP BY 1)"

_GROUP_ROWS = """
lb AS (SELECT doc_id, max(quality) AS quality FROM labels GROUP BY 1),
rp AS (SELECT sha256(text) AS h, min(doc_id) AS rep FROM documents GROUP BY 1 HAVING count(*) > 1),
r AS (
  SELECT rep, d.doc_id AS idx, '/' || CASE WHEN d.doc_id % 3 = 0 THEN source || '/' ELSE '' END || CAST(d.doc_id AS VARCHAR) || '.txt' AS path,
    n_chars + d.doc_id % 5 AS byte_size, d.doc_id * 7919 % 1000 AS modified,
    CASE WHEN quality IS NOT NULL THEN n_chars / 100.0 + d.doc_id % 7 END AS duration,
    CASE WHEN d.doc_id % 4 <> 0 THEN 44100.0 + d.doc_id % 2 * 3900 END AS sample_rate,
    CASE WHEN d.doc_id % 3 <> 0 THEN 8 + d.doc_id % 3 * 8 END AS bit_depth, 1 + d.doc_id % 2 AS channel_count, quality = 1 AS lossless
  FROM documents d JOIN rp ON sha256(d.text) = rp.h LEFT JOIN lb ON lb.doc_id = d.doc_id
)
"""


def _sign(better: str, worse: str) -> str:
    return f"CASE WHEN {better} THEN -1 WHEN {worse} THEN 1 END"


def _quality(a: str, b: str) -> str:
    """Positive if b is worse than a, as SQL over two structs."""

    def more(x: str, y: str) -> str:
        return _sign(f"{x} > {y}", f"{x} < {y}")

    def rate(f: str) -> str:
        return f"coalesce(CASE WHEN {f}.duration > 0.05 THEN round({f}.byte_size * 8 / {f}.duration / 1000) END, 0.0)"

    la, lb = f"coalesce({a}.lossless, false)", f"coalesce({b}.lossless, false)"
    tests = [
        _sign(f"{a}.duration IS NOT NULL AND {b}.duration IS NULL", f"{b}.duration IS NOT NULL AND {a}.duration IS NULL"),
        f"CASE WHEN {a}.lossless IS NOT NULL AND {b}.lossless IS NOT NULL THEN {_sign(f'{la} AND NOT {lb}', f'{lb} AND NOT {la}')} END",
        f"CASE WHEN NOT {la} AND NOT {lb} THEN {more(rate(a), rate(b))} END",
        *(more(f"{a}.{k}", f"{b}.{k}") for k in ("sample_rate", "bit_depth", "channel_count")),
        more(f"-{a}.byte_size", f"-{b}.byte_size"),
        more(f"-length({a}.path)", f"-length({b}.path)"),
    ]
    return f"-coalesce({', '.join(tests)}, 0)"


_BEST = f"""
lg AS (SELECT *, max(duration) OVER (PARTITION BY rep) AS longest FROM r),
cp AS (SELECT * FROM lg WHERE longest IS NULL OR coalesce(duration, longest) >= longest * 0.95),
kp AS (SELECT rep, list_reduce(list(struct_pack(idx := idx, path := path, byte_size := byte_size, duration := duration, sample_rate := sample_rate, bit_depth := bit_depth, channel_count := channel_count, lossless := lossless) ORDER BY idx),
       lambda best, y: CASE WHEN {_quality("best", "y")} <= 0 THEN y ELSE best END).idx AS idx FROM cp GROUP BY rep)
"""


def _keep(order: str) -> str:
    return f"WITH {_GROUP_ROWS} SELECT rep, idx FROM (SELECT rep, idx, row_number() OVER (PARTITION BY rep ORDER BY {order}) AS rn FROM r) WHERE rn = 1"


#: What the formats are, written out here and not taken from the engine.
_FORMAT_FACTS = """
WITH p AS (SELECT path, lower(regexp_extract(path, '[.]([^./]*)$', 1)) AS e FROM (SELECT unnest([
  '/music/song.wav', '/music/song.wave', '/music/song.aif', '/music/song.aiff', '/music/song.aifc', '/music/song.mp3', '/music/song.m4a', '/music/song.m4b', '/music/song.m4r',
  '/music/song.aac', '/music/song.adts', '/music/song.caf', '/music/song.flac', '/music/song.alac', '/music/song.ogg', '/music/song.oga', '/music/song.opus', '/music/song.wma',
  '/music/song.wv', '/music/song.ape', '/music/song.mka', '/music/song.ra', '/music/song.au', '/music/song.snd', '/music/song.amr', '/music/song.ac3', '/music/song.sd2',
  '/music/song.txt', '/music/song', '/music/song.MP3']) AS path)),
b AS (SELECT *, e IN ('opus', 'wma', 'wv', 'ape', 'mka', 'ra', 'au', 'snd', 'amr', 'ac3', 'sd2') AS bytes_only FROM p)
SELECT path, e AS extension, bytes_only OR e IN ('wav', 'wave', 'aif', 'aiff', 'aifc', 'mp3', 'm4a', 'm4b', 'm4r', 'aac', 'adts', 'caf', 'flac', 'alac', 'ogg', 'oga') AS is_audio, bytes_only,
  CASE WHEN e IN ('flac', 'alac', 'wv', 'ape', 'wav', 'wave', 'aif', 'aiff', 'aifc') THEN true WHEN e IN ('mp3', 'aac', 'adts', 'opus', 'wma', 'ra', 'amr', 'ac3', 'ogg', 'oga') THEN false END AS lossless,
  CASE e WHEN 'opus' THEN 'Opus' WHEN 'wma' THEN 'Windows Media Audio' WHEN 'wv' THEN 'WavPack' WHEN 'ape' THEN 'Monkey''s Audio' WHEN 'mka' THEN 'Matroska Audio' WHEN 'ra' THEN 'RealAudio'
    WHEN 'ac3' THEN 'AC-3' WHEN 'amr' THEN 'AMR' WHEN 'sd2' THEN 'Sound Designer II' ELSE upper(e) END AS label
FROM b
"""

_CODEC_FACTS = """
WITH c AS (SELECT unnest(['pcm_s16le', 'pcm_u8', 'pcm_f32be', 'flac', 'alac', 'mp3', 'aac', 'vorbis', 'pcm_alaw', 'pcm_mulaw', 'opus', 'wmav2']) AS codec),
e AS (SELECT * FROM (VALUES ('wav', 16), ('m4a', 0), ('ogg', NULL), ('opus', 24)) v(ext, depth)),
f AS (SELECT *, codec IN ('pcm_s16le', 'pcm_u8', 'pcm_f32be', 'flac', 'alac') AS lossless_codec FROM c, e)
SELECT codec, ext, depth,
  CASE codec WHEN 'mp3' THEN 'MP3' WHEN 'aac' THEN 'AAC' WHEN 'alac' THEN 'Apple Lossless' WHEN 'flac' THEN 'FLAC' WHEN 'vorbis' THEN 'Ogg Vorbis' WHEN 'pcm_alaw' THEN 'A-law' WHEN 'pcm_mulaw' THEN 'µ-law'
    ELSE upper(ext) || CASE WHEN lossless_codec THEN ' (PCM)' ELSE '' END END AS name,
  lossless_codec, CASE WHEN codec NOT IN ('flac', 'alac') AND depth > 0 THEN depth END AS meaningful,
  CASE WHEN depth IS NOT NULL THEN lossless_codec WHEN ext = 'ogg' THEN false END AS lossless,
  CASE WHEN ext = 'opus' THEN 'no Opus decoder available — only exact copies of this file can be found' WHEN depth = 24 THEN 'broken' WHEN depth / 10.0 < 2.0 THEN 'shorter than 2s' END AS reason
FROM f
"""

_SOUND = "d AS (SELECT doc_id AS idx, octet_length(encode(text)) AS n, hex(encode(text)) AS h FROM documents)"

_RECORDINGS = """
li AS (SELECT l_orderkey // 2000 AS rec, (l_extendedprice - 53000) / 52000 * CASE WHEN l_orderkey % 2000 < 50 THEN 0.001 ELSE 1.0 END AS v,
       row_number() OVER (PARTITION BY l_orderkey // 2000 ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice) - 1 AS i FROM lineitem)
"""

_PRINTS = f"""
WITH {_RECORDINGS},
pk AS (SELECT rec, max(abs(v)) AS peak, count(*) AS samples FROM li GROUP BY 1),
rg AS (SELECT li.rec, min(i) AS s, max(i) + 1 AS e FROM li JOIN pk ON pk.rec = li.rec WHERE abs(v) >= 0.005 * peak GROUP BY 1),
fc AS (SELECT *, CASE WHEN e - s >= 4608 THEN (e - s - 4096) // 512 + 1 ELSE 0 END AS frames FROM rg),
fs AS (SELECT rec, s, unnest(range(frames)) AS f FROM fc),
fr AS (SELECT li.rec, f, i - s - f * 512 AS j, v * sqrt(2 / 3) * 2 * pow(sin(pi() * (i - s - f * 512) / 4096), 2) AS v FROM li JOIN fs ON fs.rec = li.rec AND i - s BETWEEN f * 512 AND f * 512 + 4095),
ed AS (SELECT m, CAST(floor(300 * pow(10, m / 33) * 4096 / 11025 + 0.5) AS BIGINT) AS low, CAST(floor(300 * pow(10, (m + 1) / 33) * 4096 / 11025 + 0.5) AS BIGINT) AS high FROM range(33) t(m)),
bn AS (SELECT m, unnest(range(low, high)) AS k FROM ed),
sp AS (SELECT rec, f, m, k, sum(v * cos(2 * pi() * (k * j % 4096) / 4096)) AS re, sum(v * sin(2 * pi() * (k * j % 4096) / 4096)) AS im FROM fr, bn GROUP BY ALL),
en AS (SELECT rec, f, m, log10(sum(re * re + im * im) + 1e-9) AS l FROM sp GROUP BY ALL),
st AS (SELECT a.rec, a.f, a.m, a.l - b.l AS step FROM en a JOIN en b ON a.rec = b.rec AND a.f = b.f AND b.m = a.m + 1),
bt AS (SELECT a.rec, a.f, sum(CASE WHEN a.step - b.step > 0 THEN CAST(1 AS BIGINT) << a.m ELSE 0 END) AS value FROM st a JOIN st b ON a.rec = b.rec AND a.m = b.m AND b.f = a.f - 1 GROUP BY ALL),
bx AS (SELECT rec, bit_xor(CAST(value AS BIGINT)) AS value_xor FROM bt GROUP BY 1),
ch AS (SELECT a.rec, a.f, sum(abs(a.l - b.l)) / 33 AS change FROM en a JOIN en b ON a.rec = b.rec AND a.m = b.m AND b.f = a.f - 1 GROUP BY ALL),
fx AS (SELECT rec, list_sort(list(change))[count(*) // 2 + 1] AS flux FROM ch GROUP BY 1),
mn AS (SELECT rec, m, avg(l) AS mean FROM en GROUP BY ALL),
sh AS (SELECT rec, string_agg(CAST(CAST(floor((greatest(-8.0, mean - top) + 8) / 8 * 255 + 0.5) AS INT) AS VARCHAR), ',' ORDER BY m) AS shape FROM (SELECT *, max(mean) OVER (PARTITION BY rec) AS top FROM mn) GROUP BY 1)
SELECT pk.rec, samples, s AS start, e AS "end", frames, coalesce(shape, '') AS shape, coalesce(round(flux, 3), 1e9) AS flux, coalesce(value_xor, 0) AS value_xor
FROM pk JOIN fc ON fc.rec = pk.rec LEFT JOIN sh ON sh.rec = pk.rec LEFT JOIN fx ON fx.rec = pk.rec LEFT JOIN bx ON bx.rec = pk.rec
"""

_RESAMPLED = f"""
WITH {_RECORDINGS},
mo AS (SELECT rec, i // 2 AS i, avg(v) AS v FROM li GROUP BY ALL HAVING count(*) = 2),
ln AS (SELECT rec, count(*) AS frames, CAST(floor(count(*) * (11025 / 44100)) AS BIGINT) AS n FROM mo GROUP BY 1),
ou AS (SELECT rec, unnest(range(n)) AS o FROM ln),
tp AS (SELECT rec, o, o * 4 + k AS i, CAST(k AS DOUBLE) AS t FROM ou, range(-127, 129) r(k)),
kr AS (SELECT rec, o, i, 0.2375 * CASE WHEN t = 0 THEN 1 ELSE sin(pi() * 0.2375 * t) / (pi() * 0.2375 * t) END
       * (0.35875 - 0.48829 * cos(pi() * (t / 128 + 1)) + 0.14128 * cos(2 * pi() * (t / 128 + 1)) - 0.01168 * cos(3 * pi() * (t / 128 + 1))) AS w FROM tp),
re AS (SELECT kr.rec, kr.o, sum(w * v) AS y FROM kr JOIN mo ON mo.rec = kr.rec AND mo.i = kr.i GROUP BY ALL)
SELECT ln.rec, frames, n AS samples, round(sum(y), 2) AS total, round(sum(abs(y)), 2) AS magnitude FROM ln JOIN re ON re.rec = ln.rec GROUP BY ALL
"""

_ALIGNMENTS = f"""
WITH {_EXACT}, {_FRAMES},
pr AS (SELECT rep, m AS idx, a.n AS na, b.n - 37 AS nb FROM (SELECT rep, unnest(members) AS m FROM x) JOIN un a ON a.idx = rep JOIN un b ON b.idx = m WHERE m <> rep),
er AS (SELECT rep, pr.idx, p.pos - (q.pos - 37) AS off, count(*) AS overlap, sum(bit_count(xor(p.v, q.v))) AS errors
       FROM pr JOIN fr p ON p.idx = rep JOIN fr q ON q.idx = pr.idx AND q.pos >= 37 AND p.pos - (q.pos - 37) BETWEEN -600 AND 600 GROUP BY ALL HAVING count(*) >= 64),
bs AS (SELECT *, row_number() OVER (PARTITION BY rep, idx ORDER BY errors / (32 * overlap), off) AS rn FROM er)
SELECT pr.rep, pr.idx, errors / (32 * overlap) AS ber, off, overlap FROM pr LEFT JOIN bs ON bs.rep = pr.rep AND bs.idx = pr.idx AND rn = 1
"""

_NEAR = "abs(p.sec - q.sec) <= greatest(0.5, greatest(p.sec, q.sec) * 0.1)"

_SCORES = f"""
WITH {_FRAMES}, {_ALL}, {_INDEX},
it AS (SELECT doc_id AS idx, n_chars / 50.0 AS sec, doc_id % 2 = 0 AS still, list_transform(range(1, 33), lambda i: (instr('0123456789abcdef', substr(md5(text), i, 1)) - 1) * 17) AS shape FROM documents),
us2 AS (SELECT it.* FROM it JOIN un ON un.idx = it.idx),
tm AS (SELECT a, b, 1 - ber / 0.5 AS score FROM ae JOIN us2 p ON p.idx = a JOIN us2 q ON q.idx = b
       WHERE overlap >= least(na, nb) * 0.25 AND overlap * (512 / 11025) >= 3.0 AND ber <= 0.30 AND (NOT (p.still AND q.still) OR {_NEAR})),
sp AS (SELECT p.idx AS a, q.idx AS b, list_transform(range(1, 33), lambda m: greatest(p.shape[m], q.shape[m]) / 255) AS wt, list_transform(range(1, 33), lambda m: abs(p.shape[m] - q.shape[m])) AS df
       FROM us2 p JOIN us2 q ON p.idx < q.idx WHERE p.still AND q.still AND {_NEAR}),
sd AS (SELECT a, b, list_sum(list_transform(range(1, 33), lambda m: wt[m] * df[m])) / list_sum(wt) / 255 AS distance FROM sp)
SELECT a, b, round(max(greatest(0.0, least(1.0, score))), 9) AS score FROM (SELECT * FROM tm UNION ALL SELECT a, b, 1 - distance / 0.6 FROM sd WHERE distance <= 0.4) GROUP BY 1, 2
"""


def _report() -> str:
    orders = {"largest": "byte_size DESC, idx DESC", "smallest": "byte_size, idx", "oldest": "modified, idx", "newest": "modified DESC, idx DESC", "shallowest": "len(list_filter(string_split(path, '/'), lambda z: z <> '')), length(path), path"}
    firsts = ", ".join(f"first(name ORDER BY {order}) AS {rule}" for rule, order in orders.items())
    return f"""WITH {_GROUP_ROWS}, {_BEST}, nm AS (SELECT *, string_split(path, '/')[-1] AS name FROM r),
        g AS (SELECT rep, 'exact' AS kind, array_to_string(list_sort(list(name)), '|') AS paths, CAST(sum(byte_size) - max(byte_size) AS BIGINT) AS reclaimable, {firsts} FROM nm GROUP BY 1)
        SELECT kind, paths, reclaimable, name AS best_quality, {", ".join(f"g.{rule}" for rule in orders)}, row_number() OVER (ORDER BY kind, paths) - 1 AS place FROM g JOIN kp ON kp.rep = g.rep JOIN nm ON nm.idx = kp.idx"""


_TEMPORAL = f"WITH {_FRAMES}, {_ALL}, {_INDEX}"

ORACLES: dict[str, str] = {
    "size_candidates": f"WITH {_EXACT} SELECT idx, byte_size FROM c",
    "exact_groups": f"WITH {_EXACT} SELECT rep, unnest(members) AS idx FROM x",
    "exact_reclaimable": f"WITH {_EXACT} SELECT rep, content_hash, files, reclaimable FROM x",
    "representatives": f"WITH {_EXACT} SELECT idx, byte_size FROM s WHERE idx NOT IN (SELECT m FROM (SELECT unnest(members) AS m, rep FROM x) WHERE m <> rep)",
    "attribute_fill": f"WITH {_EXACT} SELECT s.idx, 'r' || CAST(coalesce(m.rep, s.idx) AS VARCHAR) AS attribute FROM s LEFT JOIN (SELECT unnest(members) AS m, rep FROM x) m ON m.m = s.idx",
    "frame_values": f"WITH {_FRAMES} SELECT d.doc_id AS idx, count(v) AS frames, coalesce(bit_xor(v), 0) AS value_xor, CAST(coalesce(sum(v), 0) AS BIGINT) AS value_sum FROM documents d LEFT JOIN fr ON fr.idx = d.doc_id GROUP BY 1",
    "key_postings": f"{_TEMPORAL} SELECT key, count(*) AS entries, count(DISTINCT idx) AS files FROM po GROUP BY 1",
    "bucket_filter": f"{_TEMPORAL} SELECT key, entries FROM bk",
    "vote_counts": f"{_TEMPORAL} SELECT a, b, CAST(sum(n) AS BIGINT) AS votes, count(*) AS offsets, max(n) AS most FROM vt GROUP BY 1, 2",
    "best_offset": f"{_TEMPORAL} SELECT a, b, off, n FROM bo",
    "aligned_ber": f"{_TEMPORAL} SELECT a, b, off, overlap, errors, round(ber, 9) AS ber FROM ae",
    "components": f"WITH RECURSIVE {_FRAMES}, {_ALL}, {_INDEX}, {_edges('very_strict')}, {_REACH} SELECT idx, component FROM comp",
    "group_confidence": f"WITH RECURSIVE {_FRAMES}, {_ALL}, {_INDEX}, {_edges('very_relaxed')}, {_REACH}, conf AS (SELECT component, min(score) AS confidence FROM ed JOIN comp ON ed.a = comp.idx GROUP BY 1) SELECT c.component AS rep, count(*) AS files, round(min(confidence), 9) AS confidence FROM comp c JOIN conf ON conf.component = c.component GROUP BY 1",
    "absorption": f"{_SIMILAR} SELECT rep, files FROM ab",
    "groups_ranked": f"{_SIMILAR} SELECT kind, rep, files, reclaimable, round(confidence, 3) AS confidence FROM gr",
    "summary_counts": f"{_SIMILAR} SELECT count(*) AS groups, CAST(coalesce(sum(files), 0) AS BIGINT) AS files, CAST(coalesce(sum(reclaimable), 0) AS BIGINT) AS reclaimable, (SELECT count(*) FROM documents) AS files_scanned FROM gr",
    "report_diff": f"{_TEMPORAL}, {_edges('perfect', 'e1')}, {_edges('very_relaxed', 'e2')}, l AS (SELECT a, count(*) AS n FROM e1 GROUP BY 1), q AS (SELECT a, count(*) AS n FROM e2 GROUP BY 1) SELECT coalesce(l.a, q.a) AS a, CASE WHEN q.a IS NULL THEN 'only_a' WHEN l.a IS NULL THEN 'only_b' WHEN l.n IS NOT DISTINCT FROM q.n THEN 'same' ELSE 'changed' END AS status, l.n AS value_a, q.n AS value_b FROM l FULL JOIN q ON l.a = q.a",
    "band_bits": f"{_SHAPES} SELECT vec_id, CAST(list_sum(list_transform(range(0, 32), lambda m: CASE WHEN (e[m + 1] - e[m + 2]) - (p[m + 1] - p[m + 2]) > 0 THEN CAST(1 AS BIGINT) << m ELSE 0 END)) AS BIGINT) AS bits FROM g WHERE p IS NOT NULL",
    "flux_median": f"{_SHAPES} SELECT idx, n, round(flux, 9) AS flux FROM fx",
    "stationary_flag": f"{_SHAPES} SELECT idx, n >= 64 AS usable, flux < 0.1 AS stationary FROM fx",
    "shape_template": f"{_SHAPES} SELECT idx, array_to_string(shape, ',') AS shape FROM sh",
    "shape_pairs": f"""{_SHAPES}, u AS (SELECT sh.idx, shape, n * (512 / 11025) AS seconds FROM sh JOIN fx ON fx.idx = sh.idx WHERE n >= 1),
        pr AS (SELECT p.idx AS a, q.idx AS b, list_transform(range(1, 34), lambda m: greatest(p.shape[m], q.shape[m]) / 255) AS wt, list_transform(range(1, 34), lambda m: abs(p.shape[m] - q.shape[m])) AS df
               FROM u p JOIN u q ON p.idx < q.idx WHERE abs(p.seconds - q.seconds) <= greatest(0.5, greatest(p.seconds, q.seconds) * 0.1)),
        ds AS (SELECT a, b, CASE WHEN list_sum(wt) = 0 THEN 0.0 ELSE list_sum(list_transform(range(1, 34), lambda m: wt[m] * df[m])) / list_sum(wt) / 255 END AS distance FROM pr)
        SELECT a, b, round(greatest(0.0, least(1.0, 1 - distance / 0.6)), 9) AS score FROM ds WHERE distance <= 0.4""",
    "silence_trim": f"""WITH {_SIGNALS}, pk AS (SELECT user_id, x, len(x) AS n, list_max(list_transform(x, lambda v: abs(v))) AS peak FROM x),
        ab AS (SELECT *, list_filter(range(0, n), lambda i: abs(x[i + 1]) >= peak * 0.005) AS above FROM pk)
        SELECT user_id, n, CASE WHEN peak <= 1e-5 THEN 0 ELSE above[1] END AS start, CASE WHEN peak <= 1e-5 THEN n ELSE above[-1] + 1 END AS "end" FROM ab""",
    "recording_prints": _PRINTS,
    "resampled": _RESAMPLED,
    "fixed_tables": """SELECT 'edge' AS kind, m AS place, floor(300 * pow(10, m / 33) * 4096 / 11025 + 0.5) AS value FROM range(34) t(m)
        UNION ALL SELECT 'window', i // 256, round(sum(pow(sqrt(2 / 3) * 2 * pow(sin(pi() * i / 4096), 2), 2)), 2) FROM range(4096) t(i) GROUP BY 2""",
    "best_alignments": _ALIGNMENTS,
    "probe_files": f"WITH {_SOUND} SELECT idx, 'pcm_u8' AS codec, CAST(8000 AS DOUBLE) AS rate, 1 AS channels, 8 AS bit_depth, n AS frames, CAST(NULL AS VARCHAR) AS error FROM d",
    "analysed_files": f"""WITH {_SOUND}, k AS (SELECT *, n >= 800 AS fine FROM d)
        SELECT idx, CASE WHEN fine THEN n / 8000.0 END AS duration, CASE WHEN fine THEN least(n, 4000) / 8000.0 < n / 8000.0 - 0.05 END AS truncated, CASE WHEN fine THEN CAST(8000 AS DOUBLE) END AS sample_rate, CASE WHEN fine THEN 8 END AS bit_depth,
        CASE WHEN fine THEN 1 END AS channel_count, CASE WHEN fine THEN 'pcm_u8' END AS codec, CASE WHEN fine THEN true END AS codec_is_lossless, CASE WHEN n = 0 THEN 'the file holds no audio' WHEN NOT fine THEN 'shorter than 0.1s' END AS error FROM k""",
    "pcm_dump": f"""WITH {_SOUND} SELECT idx, CASE WHEN n > 0 THEN least(n, 800) END AS n, CASE WHEN n > 0 THEN list_sum(list_transform(range(0, least(n, 800)), lambda i: CAST('0x' || substr(h, 2 * i + 1, 2) AS INT) - 128)) / 128 END AS total,
        CASE WHEN n = 0 THEN 'the file holds no audio' END AS error FROM d""",
    "match_scores": _SCORES,
    "report_rows": _report(),
    "keep_best_quality": f"WITH {_GROUP_ROWS}, {_BEST} SELECT rep, idx FROM kp",
    "keep_largest": _keep("byte_size DESC, idx DESC"),
    "keep_smallest": _keep("byte_size, idx"),
    "keep_oldest": _keep("modified, idx"),
    "keep_newest": _keep("modified DESC, idx DESC"),
    "keep_shallowest": _keep("len(list_filter(string_split(path, '/'), lambda z: z <> '')), length(path), path"),
    "mark_plan": f"WITH {_GROUP_ROWS}, {_BEST} SELECT r.rep, r.idx, r.byte_size, kp.idx AS keeper FROM r JOIN kp ON kp.rep = r.rep WHERE r.idx <> kp.idx",
    "marked_totals": f"WITH {_GROUP_ROWS} SELECT count(*) AS marked, CAST(sum(byte_size) AS BIGINT) AS bytes FROM (SELECT *, row_number() OVER (PARTITION BY rep ORDER BY byte_size DESC, idx DESC) AS rn FROM r) WHERE rn > 1",
    "groups_after_removal": f"WITH {_GROUP_ROWS} SELECT rep, count(*) AS files FROM (SELECT *, row_number() OVER (PARTITION BY rep ORDER BY modified, idx) AS rn FROM r) WHERE rn > 1 GROUP BY 1 HAVING count(*) > 1",
    "url_parts": r"""SELECT page_id, string_split(url, '/')[-1] AS name, regexp_replace(url, '/[^/]*$', '') AS folder, lower(regexp_extract(string_split(url, '/')[-1], '^.+\.([^.]*)$', 1)) AS extension,
        CAST(len(list_filter(string_split(url, '/'), lambda z: z <> '')) + CASE WHEN starts_with(url, '/') THEN 1 ELSE 0 END AS BIGINT) AS depth, length(url) AS length FROM pages""",
    "bitrate": "SELECT l_orderkey, l_linenumber, CASE WHEN CAST(l_quantity AS DOUBLE) - 1 > 0.05 THEN CAST(round(CAST(l_extendedprice AS DOUBLE) * 8 / (CAST(l_quantity AS DOUBLE) - 1) / 1000) AS BIGINT) END AS kbps FROM lineitem",
    "quality_summary": rf"""WITH {_GROUP_ROWS}, q AS (SELECT idx, lossless, CASE WHEN duration > 0.05 THEN CAST(round(byte_size * 8 / duration / 1000) AS BIGINT) END AS kbps,
        concat_ws(' · ', regexp_replace(printf('%.4f', sample_rate / 1000), '\.?0+$', '') || ' kHz', CAST(bit_depth AS VARCHAR) || '-bit') AS t FROM r)
        SELECT idx, CASE WHEN coalesce(lossless, false) AND t <> '' THEN t WHEN kbps IS NOT NULL THEN CAST(kbps AS VARCHAR) || ' kbps' ELSE '—' END AS summary FROM q""",
    "format_texts": """WITH d AS (SELECT doc_id, n_chars * 1000 AS z, n_chars AS s FROM documents)
        SELECT doc_id, CASE WHEN z < 1000 THEN CAST(z AS VARCHAR) || ' B' WHEN z < 1000000 THEN printf('%.1f KB', z / 1e3) WHEN z < 1000000000 THEN printf('%.1f MB', z / 1e6) ELSE printf('%.1f GB', z / 1e9) END AS bytes,
        CASE WHEN s >= 3600 THEN printf('%d:%02d:%02d', s // 3600, s % 3600 // 60, s % 60) ELSE printf('%d:%02d', s // 60, s % 60) END AS duration,
        CASE WHEN doc_id % 3 = 0 THEN 'Identical' WHEN doc_id % 2 = 0 THEN 'Same recording' ELSE CAST(CAST(round((doc_id % 101) / 100 * 100) AS INT) AS VARCHAR) || '% match' END AS badge FROM d""",
}
ORACLES |= {"format_facts": _FORMAT_FACTS, "codec_facts": _CODEC_FACTS}
ORACLES["content_seconds"] = """WITH c AS (SELECT l_returnflag, greatest(0.0, l_quantity - l_discount * 100 - CASE WHEN l_returnflag = 'R' THEN 0.0 ELSE l_tax * 100 END) AS s FROM lineitem)
    SELECT l_returnflag, count(*) AS n, round(sum(s), 3) AS seconds, CAST(sum(CASE WHEN s = 0 THEN 1 ELSE 0 END) AS BIGINT) AS empty FROM c GROUP BY 1"""
ORACLES |= {f"edges_{level}": f"{_TEMPORAL}, {_edges(level)} SELECT a, b, round(score, 9) AS score FROM ed" for level in _LEVELS}
