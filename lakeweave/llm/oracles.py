"""SQL twins, for DuckDB, of those corpus queries that SQL can express."""

from __future__ import annotations

_SYMBOLS = "[#*$%&|<>]"
_WORD = r"[^\x20\x09-\x0D]+"

_RULES = {
    "symbols": ("10 * n_symbols > n_words", "5 * n_symbols > n_words"),
    "repeated_lines": ("20 * n_dup_lines > n_words", "10 * n_dup_lines > n_words"),
    "word_length": ("word_chars > 10 * n_words OR word_chars < 3 * n_words", "word_chars > 20 * n_words OR 2 * word_chars < 3 * n_words"),
}


def _op3() -> str:
    failed = ", ".join(f"count(*) FILTER (WHERE {r}) AS {n}" for n, (r, _) in _RULES.items())
    moments = ", ".join(f"sum({n}) / sum(n) AS m_{n}, sum({n} * {n} / n) / sum(n) AS s_{n}" for n in _RULES)
    between = ", ".join(f"m_{n}, s_{n} - m_{n} * m_{n} - m_{n} * (1 - m_{n}) * hosts / total AS b_{n}" for n in _RULES)
    strength = ", ".join(f"m_{n}, least(greatest(CASE WHEN b_{n} > 1e-12 THEN m_{n} * (1 - m_{n}) / b_{n} - 1 ELSE 10000 END, 2), 10000) AS k_{n}" for n in _RULES)
    rates = ", ".join(f"m_{n}, k_{n}, ({n} + m_{n} * k_{n}) / (n + k_{n}) AS r_{n}" for n in _RULES)
    off = ", ".join(f"m_{n}, r_{n}, 3 * sqrt(r_{n} * (1 - r_{n}) / (n + k_{n} + 1)) AS d_{n}" for n in _RULES)
    worst = " OR ".join(f"r_{n} - d_{n} > greatest(m_{n}, 0.5)" for n in _RULES)
    gone = " OR ".join(f"(({mild}) AND r_{n} - d_{n} > m_{n}) OR (({severe}) AND NOT r_{n} + d_{n} < m_{n} / 2)" for n, (mild, severe) in _RULES.items())
    return rf"""
        WITH docs AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(source, '') AS host, coalesce(text, '') AS t FROM documents),
        split AS (
            SELECT rid, doc_id, host, t, regexp_extract_all(t, '{_WORD}') AS words,
                   list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '{_WORD}')) AS lines FROM docs),
        windows AS (
            SELECT rid, i, [words[i], words[i + 1], words[i + 2]] AS w
            FROM (SELECT rid, words, unnest(generate_series(1, len(words) - 2)) AS i FROM split)),
        again AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, w) AS n FROM windows) WHERE n > 1),
        covered AS (SELECT rid, count(DISTINCT i + k) AS n FROM again, (SELECT unnest([0, 1, 2]) AS k) GROUP BY rid),
        counts AS (
            SELECT s.rid, doc_id, host, len(words)::BIGINT AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
                   len(regexp_extract_all(t, '{_SYMBOLS}'))::BIGINT AS n_symbols,
                   (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(c.n, 0)::BIGINT AS n_repeat_words
            FROM split s LEFT JOIN covered c USING (rid)),
        by_host AS (SELECT host, count(*)::DOUBLE AS n, {failed} FROM counts GROUP BY host),
        moments AS (SELECT sum(n) AS total, count(*) AS hosts, {moments} FROM by_host),
        between_hosts AS (SELECT {between} FROM moments),
        prior AS (SELECT {strength} FROM between_hosts),
        posterior AS (SELECT host, n, {rates} FROM by_host, prior),
        rates AS (SELECT host, {off} FROM posterior),
        judged AS (
            SELECT c.*, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
                   ({worst}) AS host_blocked, {gone} AS failed
            FROM counts c JOIN rates USING (host))
        SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
               NOT base_failed AND NOT host_blocked AND NOT failed AS kept, host_blocked FROM judged"""


_OP9 = """
    WITH pages_ AS (SELECT page_id, coalesce(html, '') AS payload FROM pages),
    digests AS (SELECT page_id, strlen(payload)::BIGINT AS payload_bytes, sha1(payload) AS payload_digest FROM pages_),
    firsts AS (SELECT *, CASE WHEN payload_bytes >= 1000 THEN max(page_id) OVER (PARTITION BY payload_digest) END AS first FROM digests)
    SELECT page_id, payload_bytes, payload_digest, CASE WHEN first IS NOT NULL AND page_id IS DISTINCT FROM first THEN 'revisit' ELSE 'response' END AS record_type,
           CASE WHEN page_id IS DISTINCT FROM first THEN first END AS refers_to FROM firsts"""


# XXH64 (seed 42) in SQL: 64-bit arithmetic within 128-bit numbers. The five primes of the algorithm.
_P1, _P2, _P3, _P4, _P5 = 11400714785074694791, 14029467366897019727, 1609587929392839161, 9650029242287828579, 2870177450012600261
_SEED, _M = 42, 1 << 64


def _times(x: str, p: int) -> str:
    return f"((({x})::UHUGEINT * {p}::UHUGEINT) % {_M}::UHUGEINT)::UBIGINT"


def _plus(x: str, y: str | int) -> str:
    return f"((({x})::UHUGEINT + ({y})::UHUGEINT) % {_M}::UHUGEINT)::UBIGINT"


def _turn(x: str, n: int) -> str:
    return f"(({x})::UBIGINT >> {64 - n}) + ((({x})::UHUGEINT * {1 << n}::UHUGEINT) % {_M}::UHUGEINT)::UBIGINT"


def _xor(x: str, y: str) -> str:
    return f"xor(({x})::UBIGINT, ({y})::UBIGINT)"


def _little(h: str, at: str, n: int) -> str:
    """The n bytes from byte `at` on of a hex text, as a little-endian number."""
    digits = " || ".join(f"substr({h}, 2 * ({at}) + {2 * i + 1}, 2)" for i in reversed(range(n)))
    return f"CAST('0x' || {digits} AS UBIGINT)"


def _xxh64(shingles: str) -> str:
    """CTEs from `shingles`(rid, s) to `hashes`(rid, h)."""
    lanes = lambda first, count, step: f"list_transform(generate_series(0, {count} - 1), lambda k: {_little('x', f'{first} + k * {step}', 8)})"
    starts = [(_SEED + _P1 + _P2) % _M, (_SEED + _P2) % _M, _SEED, (_SEED - _P1) % _M]
    sums = ", ".join(
        f"list_reduce(list_prepend({v}::UBIGINT, {lanes(8 * j, 'n // 32', 32)}), lambda a, k: {_times(_turn(_plus('a', _times('k', _P2)), 31), _P1)}) AS v{j}" for j, v in enumerate(starts)
    )
    folded = "".join(
        f"m{j + 1} AS (SELECT * EXCLUDE (a), {_plus(_times(_xor('a', _times(_turn(_times(f'v{j}', _P2), 31), _P1)), _P1), _P4)} AS a FROM m{j})," for j in range(4)
    )
    first = _plus(_plus(_turn("v0", 1), _turn("v1", 7)), _plus(_turn("v2", 12), _turn("v3", 18)))
    eight = _plus(_times(_turn(_xor("a", _times(_turn(_times("k", _P2), 31), _P1)), 27), _P1), _P4)
    four = _plus(_times(_turn(_xor("a", _times(_little("x", "n - n % 8", 4), _P1)), 23), _P2), _P3)
    one = _times(_turn(_xor("a", _times("k", _P5)), 11), _P1)
    rest = "n % 8 >= 4"
    bytes_ = f"list_transform(generate_series(0, n % 4 - 1), lambda k: {_little('x', 'n - n % 4 + k', 1)})"
    return f"""
        texts AS (SELECT rid, hex(s) AS x, strlen(s) AS n FROM {shingles}),
        short AS (SELECT rid, x, n, {(_SEED + _P5) % _M}::UBIGINT AS a FROM texts WHERE n < 32),
        long AS (SELECT rid, x, n, {sums} FROM texts WHERE n >= 32),
        m0 AS (SELECT *, {first} AS a FROM long), {folded}
        started AS (SELECT rid, x, n, {_plus("a", "n")} AS a FROM (SELECT rid, x, n, a FROM short UNION ALL SELECT rid, x, n, a FROM m4)),
        eights AS (SELECT rid, x, n, list_reduce(list_prepend(a, {lanes("n - n % 32", "(n % 32) // 8", 8)}), lambda a, k: {eight}) AS a FROM started),
        fours AS (SELECT rid, x, n, CASE WHEN {rest} THEN {four} ELSE a END AS a FROM eights),
        ones AS (SELECT rid, list_reduce(list_prepend(a, {bytes_}), lambda a, k: {one}) AS a FROM fours),
        end1 AS (SELECT rid, {_times(_xor("a", "a >> 33"), _P2)} AS a FROM ones),
        end2 AS (SELECT rid, {_times(_xor("a", "a >> 29"), _P3)} AS a FROM end1),
        hashes AS (SELECT rid, {_xor("a", "a >> 32")} AS h FROM end2)"""


def _op10() -> str:
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    bits = " + ".join(f"CASE WHEN 2 * sum((h >> {b}) & 1) > count(*) THEN {1 << b}::UHUGEINT ELSE 0::UHUGEINT END" for b in range(64))
    return rf"""
        WITH RECURSIVE docs AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{upper}', '{lower}'), '{_WORD}') AS w FROM documents),
        shingles AS (SELECT rid, unnest(list_transform(generate_series(1, greatest(1, len(w) - 2)), lambda i: array_to_string(w[i:i + 2], ' '))) AS s FROM docs WHERE len(w) > 0),
        {_xxh64("shingles")},
        prints AS (SELECT rid, ({bits})::UBIGINT AS f FROM hashes GROUP BY rid),
        marked AS (SELECT doc_id, coalesce(f, 0)::UBIGINT AS f FROM docs LEFT JOIN prints USING (rid)),
        nodes AS (SELECT f, min(doc_id) AS least FROM marked GROUP BY f),
        links AS (SELECT a.f AS a, b.f AS b FROM nodes a, nodes b WHERE bit_count(xor(a.f, b.f)) <= 3),
        reach AS (SELECT f AS a, f AS b FROM nodes UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a),
        named AS (SELECT a AS f, min(least) AS component_id FROM reach JOIN nodes ON reach.b = nodes.f GROUP BY a)
        SELECT doc_id, lower(printf('%016x', f)) AS fingerprint, component_id FROM marked JOIN named USING (f)"""


# Line-block distribution over the block elements that the driver's pages have; article elements are not looked for. A run between
# dive points is main text if some line of two lines' windows surges; names of containers are asked only on pages where none does,
# and for runs that surge within them.
_OP7 = r"""
    WITH bodies AS (SELECT row_number() OVER () AS rid, page_id, url, regexp_replace(coalesce(html, ''), '(?s)<head>.*?</head>|<!--.*?-->', '', 'g') AS h FROM pages),
    split AS (SELECT rid, regexp_extract_all(h, '<[^>]*>|[^<]+') AS ts FROM bodies),
    tokens AS (SELECT rid, unnest(ts) AS t, generate_subscripts(ts, 1) AS i FROM split),
    marked AS (
        SELECT rid, i, t, starts_with(t, '<') AS tag,
               sum(CASE WHEN t IN ('<nav>', '<footer>', '<div class="ad">') THEN 1 WHEN t IN ('</nav>', '</footer>', '</div>') THEN -1 ELSE 0 END) OVER w AS aside,
               sum(CASE WHEN starts_with(t, '<a ') THEN 1 WHEN t = '</a>' THEN -1 ELSE 0 END) OVER w AS anchor,
               sum(CASE WHEN regexp_matches(t, '^</?(html|body|nav|ul|li|div|article|h1|p|footer)[ >]') THEN 1 ELSE 0 END) OVER w AS line
        FROM tokens WINDOW w AS (PARTITION BY rid ORDER BY i)),
    raw AS (
        SELECT rid, line, bool_or(aside > 0) AS named, string_agg(CASE WHEN NOT tag THEN t WHEN t = '<br>' THEN ' ' ELSE '' END, '' ORDER BY i) AS t,
               sum(CASE WHEN NOT tag AND anchor > 0 THEN length(trim(t)) ELSE 0 END) AS linked
        FROM marked GROUP BY rid, line),
    plain AS (SELECT rid, line, named, linked, trim(regexp_replace(replace(replace(replace(replace(replace(replace(replace(regexp_replace(trim(t), '&(amp|lt|gt|quot)$', '&\1;'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#x27;', ''''), '&copy;', '©'), '&middot;', '·'), '&amp;', '&'), '\s+', ' ', 'g')) AS t FROM raw),
    lines AS (SELECT rid, line, named, t, length(t) AS n FROM plain WHERE t <> '' AND 2 * linked <= length(t)),
    cut AS (SELECT *, CASE WHEN line - lag(line) OVER w <= 2 AND named = lag(named) OVER w THEN 0 ELSE 1 END AS starts, CASE WHEN lead(line) OVER w = line + 1 THEN lead(n) OVER w ELSE 0 END AS following FROM lines WINDOW w AS (PARTITION BY rid ORDER BY line)),
    numbered AS (SELECT *, sum(starts) OVER (PARTITION BY rid ORDER BY line) AS run FROM cut),
    runs AS (SELECT rid, run, bool_or(named) AS named, max(n + following) AS peak FROM numbered GROUP BY rid, run),
    chosen AS (SELECT rid, run FROM (SELECT *, max(peak) FILTER (NOT named) OVER (PARTITION BY rid) AS most FROM runs) WHERE NOT named AND (peak >= 130 OR most < 130)),
    texts AS (SELECT rid, string_agg(t, chr(10) || chr(10) ORDER BY line) AS text FROM numbered JOIN chosen USING (rid, run) GROUP BY rid)
    SELECT page_id, url, coalesce(text, '') AS text, coalesce(length(text), 0)::BIGINT AS n_chars FROM bodies LEFT JOIN texts USING (rid)"""


def _op1() -> str:
    """Streams spelt out in hexadecimal. The frames' headers with their CRC-16 and nine bytes of side information."""
    lead = {144: "FFF2D8C0E1F0000000000000000000", 160: "FFF2E8C01DFA000000000000000000"}
    crc = lambda pairs: f"xor(list_reduce(list_prepend(4294967295::UBIGINT, list_transform({pairs}, lambda p: CAST('0x' || p AS UBIGINT))), lambda a, b: xor(a >> 8, crcs[CAST(xor(a, b) & 255 AS INTEGER) + 1])), 4294967295::UBIGINT)"
    bit = "list_reduce(list_prepend(i::UBIGINT, [0::UBIGINT, 0::UBIGINT, 0::UBIGINT, 0::UBIGINT, 0::UBIGINT, 0::UBIGINT, 0::UBIGINT, 0::UBIGINT]), lambda x, k: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384::UBIGINT) ELSE x >> 1 END)"
    seven = lambda n: " || ".join(f"printf('%02X', (({n}) >> {s}) & 127)" for s in (21, 14, 7, 0))
    field = lambda name, value: f"'54585858' || {seven(f'{len(name) + 2} + length({value})')} || '0000' || '03{name.encode().hex().upper()}00' || hex({value})"
    ends = lambda j: f"(648 + (({j}) // 2) * 1368 + (({j}) % 2) * 648)"
    return rf"""
        WITH crcs AS (SELECT list({bit} ORDER BY i) AS crcs FROM (SELECT unnest(generate_series(0, 255)) AS i)),
        raw AS (SELECT row_number() OVER () AS rid, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
        padded AS (SELECT rid, doc_id, length(h) // 2 AS n_bytes, h || repeat('FF', CASE WHEN h = '' THEN 576 ELSE (576 - (length(h) // 2) % 576) % 576 END) AS h FROM raw),
        payloads AS (SELECT *, length(h) // 2 AS payload_bytes, length(h) // 1152 AS n FROM padded),
        sums AS (SELECT p.*, {crc("regexp_extract_all(h, '..')")} AS crc, {crc("regexp_extract_all(right(h, 64), '..')")} AS tail_crc32 FROM payloads p, crcs),
        told AS (SELECT *, {ends("n")} AS total, n_bytes::VARCHAR AS told_bytes, printf('%08x', crc) AS told_crc FROM sums),
        tagged AS (SELECT *, {field("payload_bytes", "told_bytes")} || {field("payload_crc32", "told_crc")} AS fields FROM told),
        parts AS (
            SELECT *, '494433040000' || {seven("length(fields) // 2")} || fields AS tag,
                   '{lead[144]}' || hex('Xing') || '00000007' || printf('%08X', n) || printf('%08X', total)
                   || array_to_string(list_transform(generate_series(0, 99), lambda i: printf('%02X', least(255, 256 * {ends("i * n // 100")} // total))), '') || repeat('00', 517) AS first,
                   array_to_string(list_transform(generate_series(0, n - 1), lambda i: CASE WHEN i % 2 = 0 THEN '{lead[144]}' || substr(h, i * 1152 + 1, 1152) || repeat('00', 57) ELSE '{lead[160]}' || substr(h, i * 1152 + 1, 1152) || repeat('00', 129) END), '') AS frames
            FROM tagged),
        media AS (SELECT *, unhex(tag || first || frames) AS m, length(tag) // 2 AS ahead FROM parts)
        SELECT doc_id, n_bytes::BIGINT AS n_bytes, payload_bytes::BIGINT AS payload_bytes, sha256(unhex(h)) AS payload_sha256, tail_crc32::BIGINT AS tail_crc32,
               octet_length(m)::BIGINT AS media_bytes, sha256(m) AS media_sha256,
               printf('mpeg2-layer3 16000Hz frames=%d samples=%d seconds=%d/16000 kbps=144-%d table=Xing:ok crc=%d/%d tags=id3v2.4 resyncs=0 skipped=0',
                      n, payload_bytes, payload_bytes, CASE WHEN n > 1 THEN 160 ELSE 144 END, n + 1, n + 1) AS feature,
               n::BIGINT AS n_frames, payload_bytes::BIGINT AS n_samples, 16000 AS sample_rate,
               array_to_string(list_transform(generate_series(0, n - 1), lambda j: (ahead + {ends("j")})), ',') AS seek_offsets
        FROM media"""


def oracle_sql() -> dict[str, str]:
    return {"op1_mpeg_audio": _op1(), "op3_quality_rules": _op3(), "op7_html_extraction": _OP7, "op9_warc": _OP9, "op10_simhash": _op10()}
