"""SQL of the operators' queries, where SQL can state their results."""

from __future__ import annotations

from string import ascii_lowercase, ascii_uppercase

from .media import RATE, UNIT
from .near_dup import PERCENT
from .quality import LEAST_GROUP, MEASURES, SPREADS

_SPREAD = "CASE " + " ".join(f"WHEN measure='{k}' THEN greatest(q.high-q.mid, q.mid-q.low, {least})" for k, (_, least) in MEASURES.items()) + " END"


def _quartiles(name: str, keys: list[str]) -> str:
    k = "".join(f"{x}, " for x in keys)
    part = ", ".join([*keys, "measure"])
    return f"""{name} AS (SELECT {k}measure, {{'low': min(bucket) FILTER (WHERE upto*100>=docs*25), 'mid': min(bucket) FILTER (WHERE upto*100>=docs*50), 'high': min(bucket) FILTER (WHERE upto*100>=docs*75), 'docs': any_value(docs)}} q
 FROM (SELECT {k}measure, bucket, sum(n) OVER (PARTITION BY {part} ORDER BY bucket) upto, sum(n) OVER (PARTITION BY {part}) docs FROM (SELECT {k}measure, bucket, sum(n) n FROM sketch GROUP BY ALL)) GROUP BY ALL)"""


QUALITY = rf"""WITH base AS (SELECT doc_id, lang, source, coalesce(text,'') t FROM documents),
words AS (SELECT doc_id, lang, source, t, list_filter(string_split_regex(t, '[\x20\x09-\x0D]+'), lambda w: w<>'') w, list_filter(string_split(t, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) l FROM base),
numbered AS (SELECT *, row_number() OVER () k FROM words),
windows AS (SELECT k, unnest(range(1, len(w)-3)) i, w FROM numbered WHERE len(w)>=5),
grams AS (SELECT k, i, array_to_string(w[i:i+4], ' ') g FROM windows),
twice AS (SELECT k, i FROM grams QUALIFY count(*) OVER (PARTITION BY k, g)>1),
covered AS (SELECT k, count(DISTINCT i+d) n FROM twice CROSS JOIN range(5) r(d) GROUP BY 1),
counts AS (SELECT doc_id, lang, source, len(w)::bigint n_words, len(array_to_string(w,''))::bigint word_chars, len(regexp_replace(t,'[^#*$%&|<>]+','','g'))::bigint n_symbols, (len(l)-len(list_distinct(l)))::bigint n_dup_lines, coalesce(n,0)::bigint n_repeat_words, len(l)::bigint n_lines FROM numbered LEFT JOIN covered USING(k)),
m AS (SELECT *, n_words<10 OR 100*n_repeat_words>20*n_words AS base_failed, least(n_symbols*1000//greatest(word_chars,1),1000) symbols, least(word_chars*10//greatest(n_words,1),1000) word_length, least(n_dup_lines*1000//greatest(n_lines,1),1000) dup_lines, least(n_repeat_words*1000//greatest(n_words,1),1000) repeats FROM counts),
sketch AS (SELECT lang, source, measure, bucket, count(*) n FROM (SELECT lang, source, unnest(['symbols','word_length','dup_lines','repeats']) measure, unnest([symbols,word_length,dup_lines,repeats]) bucket FROM m WHERE NOT base_failed) GROUP BY ALL),
{_quartiles("q2", ["lang", "source"])}, {_quartiles("q1", ["lang"])}, {_quartiles("q0", [])},
chosen AS (SELECT a.lang, a.source, measure, CASE WHEN a.q.docs>={LEAST_GROUP} THEN a.q WHEN b.q.docs>={LEAST_GROUP} THEN b.q ELSE c.q END q FROM q2 a JOIN q1 b USING(measure) JOIN q0 c USING(measure) WHERE a.lang IS NOT DISTINCT FROM b.lang),
limits AS (SELECT lang, source, measure, q.low-{SPREADS}*({_SPREAD}) lo, q.high+{SPREADS}*({_SPREAD}) hi FROM chosen),
wide AS (SELECT lang, source, max(hi) FILTER (WHERE measure='symbols') h1, max(hi) FILTER (WHERE measure='word_length') h2, max(lo) FILTER (WHERE measure='word_length') l2, max(hi) FILTER (WHERE measure='dup_lines') h3, max(hi) FILTER (WHERE measure='repeats') h4 FROM limits GROUP BY 1,2)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND coalesce(word_length>=l2 AND symbols<=h1 AND word_length<=h2 AND dup_lines<=h3 AND repeats<=h4, true) kept
FROM m LEFT JOIN wide ON m.lang IS NOT DISTINCT FROM wide.lang AND m.source IS NOT DISTINCT FROM wide.source"""


#: Distinct texts' shingle sets are joined by shingle; components are the rows reachable through links.
_NEXT = "||' '||".join(f"lead(w,{i}) OVER o" for i in range(1, 5))
NEAR_DUPLICATES = rf"""WITH RECURSIVE texts AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text,''), '{ascii_uppercase}', '{ascii_lowercase}'), '[\x20\x09-\x0D]+'), lambda w: w<>'') w FROM documents),
words AS (SELECT doc_id, len(w) n, unnest(w) w, generate_subscripts(w, 1) i FROM texts),
grams AS (SELECT DISTINCT doc_id, g FROM (SELECT doc_id, w||' '||{_NEXT} g FROM words WINDOW o AS (PARTITION BY doc_id ORDER BY i)) WHERE g IS NOT NULL
 UNION ALL SELECT doc_id, array_to_string(w, ' ') FROM texts WHERE len(w) BETWEEN 1 AND 4),
sizes AS (SELECT doc_id, count(*) n, md5(string_agg(g, chr(10) ORDER BY g)) f FROM grams GROUP BY 1),
classes AS (SELECT f, min(doc_id) id FROM sizes GROUP BY 1),
lists AS (SELECT id, n, md5_number(g) g FROM classes JOIN sizes ON sizes.doc_id=id JOIN grams ON grams.doc_id=id),
shared AS (SELECT a.id x, b.id y, any_value(a.n) n, any_value(b.n) m, count(*) hits FROM lists a JOIN lists b ON a.g=b.g AND a.id<b.id AND 100*a.n>={PERCENT}*b.n AND 100*b.n>={PERCENT}*a.n GROUP BY 1,2),
links AS (SELECT x, y FROM shared WHERE 100*hits>={PERCENT}*(n+m-hits)),
edges AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
reach AS (SELECT id x, id y FROM classes UNION SELECT r.x, e.y FROM reach r JOIN edges e ON e.x=r.y),
least AS (SELECT x id, min(y) component FROM reach GROUP BY 1)
SELECT texts.doc_id, coalesce(n,0)::bigint n_shingles, coalesce(component, texts.doc_id) component_id, coalesce(component, texts.doc_id)=texts.doc_id kept
FROM texts LEFT JOIN sizes USING(doc_id) LEFT JOIN classes USING(f) LEFT JOIN least USING(id)"""


#: Strings of bytes are slices of the hexadecimal text, cut in parts first, as a slice of a long one costs its whole length.
REPEATED_STRINGS = rf"""WITH base AS (SELECT row_number() OVER () k, doc_id, coalesce(text,'') t FROM documents),
bytes AS (SELECT k, doc_id, hex(encode(t)) x, strlen(t) n FROM base),
parts AS (SELECT k, b, least(n-399-b, 256) m, substr(x, 2*b+1, 1310) x FROM (SELECT k, n, x, unnest(range(0, n-399, 256)) b FROM bytes WHERE n>=400)),
windows AS (SELECT k, b+i i, hash(substr(x, 2*i+1, 800)) h FROM (SELECT k, b, x, unnest(range(m)) i FROM parts)),
twice AS (SELECT k, i FROM windows SEMI JOIN (SELECT h FROM windows GROUP BY h HAVING count(*)>1) USING(h)),
starts AS (SELECT k, i, coalesce(i-lag(i) OVER (PARTITION BY k ORDER BY i)>400, true) fresh FROM twice),
runs AS (SELECT k, min(i) b, max(i)+400 e FROM (SELECT k, i, sum(fresh::int) OVER (PARTITION BY k ORDER BY i) run FROM starts) GROUP BY k, run),
cuts AS (SELECT k, count(*) n_spans, sum(e-b) n_removed, list(b ORDER BY b) b, list(e ORDER BY b) e FROM runs GROUP BY k),
gaps AS (SELECT k, x, unnest(list_zip(list_concat([0], e), list_concat(b, [n]))) g FROM cuts JOIN bytes USING(k)),
rest AS (SELECT k, string_agg(substr(x, 2*g[1]+1, 2*(g[2]-g[1])), '' ORDER BY g[1]) y FROM gaps GROUP BY k),
words AS (SELECT k, unnest(w) w, generate_subscripts(w, 1) i FROM (SELECT k, list_filter(string_split_regex(t, '[\x20\x09-\x0D]+'), lambda w: w<>'') w FROM base)),
passages AS (SELECT k, i, md5_number(string_agg(w, ' ') OVER o) h, count(*) OVER o n FROM words WINDOW o AS (PARTITION BY k ORDER BY i ROWS BETWEEN CURRENT ROW AND 49 FOLLOWING)),
again AS (SELECT k, i FROM passages WHERE n=50 QUALIFY count(*) OVER (PARTITION BY h)>1),
told AS (SELECT k, sum(least(50, coalesce(later-i, 50))) n FROM (SELECT k, i, lead(i) OVER (PARTITION BY k ORDER BY i) later FROM again) GROUP BY k)
SELECT doc_id, bytes.n::bigint n_bytes, coalesce(n_removed,0)::bigint n_removed, coalesce(n_spans,0)::bigint n_spans, sha256(unhex(coalesce(y, x))) kept_sha256, coalesce(told.n,0)::bigint n_passage_words
FROM bytes LEFT JOIN cuts USING(k) LEFT JOIN rest USING(k) LEFT JOIN told USING(k)"""


#: Every lag of every two equal words, as islands of consecutive words; the checksum of the id is computed bit by bit.
PERIODIC_RUNS = r"""WITH ids AS (SELECT row_number() OVER () k, doc_id, list_filter(string_split_regex(coalesce(text,''), '[\x20\x09-\x0D]+'), lambda w: w<>'') w,
 xor(4294967295, list_reduce(list_prepend(4294967295::bigint, list_transform(string_split(doc_id::varchar, ''), lambda c: ascii(c)::bigint)), lambda r, c: list_reduce(list_prepend(xor(r, c), range(8)), lambda x, j: xor(x>>1, 3988292384*(x&1))))) h FROM documents),
base AS (SELECT k, doc_id, w, len(w) n, coalesce(h%10=0 AND len(w)>0, false) again, (h//10)%greatest(len(w),1) a, h//10%8 g FROM ids),
placed AS (SELECT k, doc_id, n, CASE WHEN again THEN list_transform(range(n), lambda i: w[1+CASE WHEN i<a THEN i ELSE a+(i-a)%(1+(n-a)//(3+g)) END]) ELSE w END w FROM base),
words AS (SELECT k, n, unnest(w) w, generate_subscripts(w, 1)-1 i FROM placed),
pairs AS (SELECT y.k, y.i, y.i-x.i q FROM words x JOIN words y ON x.k=y.k AND x.w=y.w AND x.i<y.i AND (y.i-x.i)*4<=y.n),
diagonals AS (SELECT k, q, i, i-row_number() OVER (PARTITION BY k, q ORDER BY i) d FROM pairs),
stretches AS (SELECT k, q, min(i)-q s, count(*)+q n FROM diagonals GROUP BY k, q, d HAVING count(*)+q>=greatest(6, 4*q)),
runs AS (SELECT k, s, n, min(q) q FROM stretches GROUP BY k, s, n),
told AS (SELECT k, count(*) n_runs, arg_min({'s': s, 'n': n, 'q': q}, (-n, s, q)) r, sha256(string_agg(s||','||n||','||q||chr(10), '' ORDER BY s, q)) runs FROM runs GROUP BY k),
dropped AS (SELECT DISTINCT k, unnest(range(s+q, s+n)) i FROM runs),
rest AS (SELECT k, string_agg(w, ' ' ORDER BY i) t FROM words ANTI JOIN dropped USING(k, i) GROUP BY k)
SELECT doc_id, coalesce(n_runs, 0)::bigint n_runs, r.s::bigint AS start, r.n::bigint AS length, r.q::bigint AS period, (1000*r.n//r.q)::bigint exponent_milli, coalesce(runs, sha256('')) runs_sha256, sha256(coalesce(t, '')) collapsed_sha256
FROM placed LEFT JOIN told USING(k) LEFT JOIN rest USING(k)"""


#: Windows of 13 words by their whole text, against the smallest document that has them.
EARLIER_PASSAGES = r"""WITH texts AS (SELECT row_number() OVER () k, doc_id, list_filter(string_split_regex(coalesce(text,''), '[\x20\x09-\x0D]+'), lambda w: w<>'') w FROM documents),
words AS (SELECT k, doc_id, unnest(w) w, generate_subscripts(w, 1) i FROM texts),
windows AS (SELECT k, doc_id, i, string_agg(w, ' ') OVER o g, count(*) OVER o n FROM words WINDOW o AS (PARTITION BY k ORDER BY i ROWS BETWEEN CURRENT ROW AND 12 FOLLOWING)),
later AS (SELECT k, i FROM windows WHERE n=13 QUALIFY doc_id>min(doc_id) OVER (PARTITION BY md5_number(g))),
gone AS (SELECT DISTINCT k, i+d i FROM later CROSS JOIN range(13) r(d)),
rest AS (SELECT k, count(*) n, string_agg(w, ' ' ORDER BY i) t FROM words ANTI JOIN gone USING(k, i) GROUP BY k)
SELECT doc_id, len(w)::bigint n_words, (len(w)-coalesce(rest.n, 0))::bigint n_removed, sha256(coalesce(t, '')) kept_sha256 FROM texts LEFT JOIN rest USING(k)"""


def _little(n: str, size: int) -> str:
    """SQL for the little-endian hexadecimal digits of n."""
    return "printf('" + "%02x" * size + "', " + ", ".join(f"({n}>>{8 * k})&255" for k in range(size)) + ")"


#: The stored file is its head, by the fields of the format, and the padded bytes; features count its bytes one by one.
_HEAD = f"'52494646'||{_little('size+36', 4)}||'57415645666d7420'||'1000000001000100'||'{RATE.to_bytes(4, 'little').hex() * 2}'||'01000800'||'64617461'||{_little('size', 4)}"
MEDIA_COLUMNS = rf"""WITH texts AS (SELECT row_number() OVER () k, doc_id, coalesce(text,'') t, strlen(coalesce(text,'')) n FROM documents),
padded AS (SELECT k, doc_id, n, greatest({UNIT}, (n+{UNIT}-1)//{UNIT}*{UNIT}) size, hex(encode(t)) x, t FROM texts),
stored AS (SELECT k, doc_id, n, size, x||repeat('20', size-n) x, encode(t||repeat(' ', size-n)) payload FROM padded),
parts AS (SELECT k, b, substr(x, 2*b+1, 512) x FROM (SELECT k, x, unnest(range(0, size, 256)) b FROM stored)),
bytes AS (SELECT k, b+i i, ('0x'||substr(x, 2*i+1, 2))::bigint v FROM (SELECT k, b, x, unnest(range(len(x)//2)) i FROM parts)),
sides AS (SELECT k, i, v*size<total low FROM bytes JOIN (SELECT k, count(*) size, sum(v) total FROM bytes GROUP BY k) USING(k)),
turns AS (SELECT k, count(*) FILTER (WHERE low<>before) crossings FROM (SELECT k, low, lag(low) OVER (PARTITION BY k ORDER BY i) before FROM sides) GROUP BY k),
loud AS (SELECT k, sum((v-128)*(v-128)) squares FROM bytes GROUP BY k),
busy AS (SELECT k, arg_max(level, (n, -level)) level FROM (SELECT k, v>>4 level, count(*) n FROM bytes GROUP BY ALL) GROUP BY k),
tails AS (SELECT k, xor(4294967295, list_reduce(list_prepend(4294967295::bigint, list_transform(range(16), lambda i: ('0x'||substr(x[-32:], 2*i+1, 2))::bigint)), lambda r, c: list_reduce(list_prepend(xor(r, c), range(8)), lambda y, j: xor(y>>1, 3988292384*(y&1))))) crc FROM stored)
SELECT doc_id, n::bigint n_bytes, size::bigint payload_bytes, sha256(payload) payload_sha256, crc::bigint tail_crc32, (size+44)::bigint media_bytes, sha256(unhex({_HEAD})||payload) media_sha256,
 printf('rms=%.4f;crossings=%d;level=%d', sqrt(squares::double/size), (1000*crossings//size)::bigint, level) feature, NULL::varchar error
FROM stored JOIN turns USING(k) JOIN loud USING(k) JOIN busy USING(k) JOIN tails USING(k)"""
