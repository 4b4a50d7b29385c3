"""Pieces of the SQL that states the expected results of the registered queries."""

from __future__ import annotations

from ..functions.vectors import FIFTHS, MAJOR, MINOR, PROFILES

SIZE = 96

NOTES = """notes AS (SELECT 'u'||user_id AS piece, 'w'||(user_id%16) AS work, (epoch_us(ts)-1704067200000000)/3.6e9 AS onset, value/60.0::double AS dur,
 (36+event_id%61)::int AS midi, event_id, event_type, value FROM events)"""


def bins(size: int = SIZE) -> str:
    return f"""{NOTES}, totals AS (SELECT piece, max(onset+dur) total FROM notes GROUP BY 1),
 spread AS (SELECT n.piece, (midi%12)::int pc, onset, onset+dur e, total, unnest(range(greatest(0,floor(onset/{size})::int), least(ceil(total/{size})::int-1, floor(least(onset+dur,total-1e-9)/{size})::int)+1)) bin
  FROM notes n JOIN totals USING(piece)),
 cells AS (SELECT piece, bin::int bin, pc, sum(greatest(0.0::double, least(e, least((bin+1)*{size}, total)) - greatest(onset, bin*{size}))) weight FROM spread GROUP BY 1,2,3)"""


def leaves(size: int = SIZE) -> str:
    """leaves(piece, leaf, start, end, mass) and dense(piece, leaf, pc, v)."""
    return f"""{bins(size)}, active AS (SELECT piece, bin, sum(weight) mass, (bin*{size}::double + least((bin+1)*{size}::double, any_value(total)))/2 centre FROM cells JOIN totals USING(piece) GROUP BY 1,2 HAVING sum(weight)>0),
 numbered AS (SELECT *, row_number() OVER w - 1 leaf, lag(centre) OVER w pc0, lead(centre) OVER w pc1 FROM active WINDOW w AS (PARTITION BY piece ORDER BY bin)),
 leaves AS (SELECT piece, bin, leaf::int leaf, coalesce((pc0+centre)/2, 0.0) AS start_qb, coalesce((pc1+centre)/2, total) AS end_qb, mass FROM numbered JOIN totals USING(piece)),
 dense AS (SELECT l.piece, l.leaf, p.pc::int pc, coalesce(c.weight, 0.0) v, l.mass FROM leaves l CROSS JOIN range(12) p(pc) LEFT JOIN cells c ON c.piece=l.piece AND c.bin=l.bin AND c.pc=p.pc),
 unit AS (SELECT piece, leaf, pc, v/mass u FROM dense)"""


PROFILE_ROWS = "profiles(k, pc, w) AS (VALUES " + ",".join(f"({k},{pc},{w}::double)" for k, p in enumerate(PROFILES) for pc, w in enumerate(p)) + ")"
ANGLES = "angles(pc, a) AS (VALUES " + ",".join(f"({pc},2*pi()*{i}/12)" for i, pc in enumerate(FIFTHS)) + ")"
MODES = "modes(major, pc, w) AS (VALUES " + ",".join(f"({m},{pc},{w / sum(p)!r}::double)" for m, p in (("true", MAJOR), ("false", MINOR)) for pc, w in enumerate(p)) + ")"


def activations(table: str, keys: str) -> str:
    """acts(keys, k, r): correlations of table(keys, pc, u) with the profiles."""
    return f"{PROFILE_ROWS}, acts AS (SELECT {keys}, k, CASE WHEN stddev_pop(u)<1e-15 THEN 0 ELSE corr(u, w) END r FROM {table} JOIN profiles USING(pc) GROUP BY {keys}, k)"


def pair_distances(size: int = SIZE) -> str:
    """pairs(piece, i, j, d): plain distances between leaves with i < j."""
    return f"""{leaves(size)}, pairs AS (SELECT a.piece, a.leaf i, b.leaf j, sqrt(sum((a.u-b.u)*(a.u-b.u))) d FROM unit a JOIN unit b ON a.piece=b.piece AND a.pc=b.pc AND a.leaf<b.leaf GROUP BY 1,2,3),
 scales AS (SELECT piece, coalesce(median(d) FILTER (WHERE d>1e-12), 1.0) scale FROM pairs GROUP BY 1), aff AS (SELECT piece, i, j, exp(-0.5*(d/scale)*(d/scale)) aff FROM pairs JOIN scales USING(piece))"""


def balanced() -> str:
    """nodes(piece, first, last, depth, split, s, e, t, n): balanced trees over the leaves; `last` is inclusive."""
    return f"""{leaves()}, ends AS (SELECT piece, max(leaf)+1 n FROM leaves GROUP BY 1),
 tree AS (SELECT piece, 0 i, n j, 0 depth, n FROM ends
  UNION ALL SELECT piece, CASE WHEN side=0 THEN i ELSE i+(j-i)//2 END, CASE WHEN side=0 THEN i+(j-i)//2 ELSE j END, depth+1, n FROM tree CROSS JOIN (VALUES (0),(1)) x(side) WHERE j-i>1),
 nodes AS (SELECT t.piece, i AS first, j-1 AS last, depth, CASE WHEN j-i>1 THEN i+(j-i)//2 END split, a.start_qb s, b.end_qb e, c.start_qb t, n
  FROM tree t JOIN leaves a ON a.piece=t.piece AND a.leaf=i JOIN leaves b ON b.piece=t.piece AND b.leaf=j-1 LEFT JOIN leaves c ON c.piece=t.piece AND j-i>1 AND c.leaf=i+(j-i)//2)"""


def program(kind: str, most: int = 8) -> str:
    """best(piece, i, j, v): the interval program unrolled by length, for pieces of at most `most` leaves."""
    first = "p0 AS (SELECT piece, leaf i, leaf+1 j, 0.0::double v FROM leaves)"
    steps = []
    if kind == "affinity":
        base = f"{pair_distances()}, ends AS (SELECT piece, max(leaf)+1 n FROM leaves GROUP BY 1), {first}"
        gain = "(n-({L}))*coalesce((SELECT sum(f.aff) FROM aff f WHERE f.piece=a.piece AND f.i>=a.i AND f.i<a.j AND f.j>=a.j AND f.j<b.j),0)"
        pick = "max"
    else:
        base = f"""{leaves()}, ends AS (SELECT piece, max(leaf)+1 n FROM leaves GROUP BY 1), spans AS (SELECT a.piece, a.leaf i, b.leaf+1 j FROM leaves a JOIN leaves b ON a.piece=b.piece AND a.leaf<=b.leaf),
 sums AS (SELECT s.piece, i, j, pc, sum(v) v FROM spans s JOIN dense d ON d.piece=s.piece AND d.leaf>=i AND d.leaf<j GROUP BY 1,2,3,4),
 units AS (SELECT *, v/sum(v) OVER (PARTITION BY piece,i,j) u FROM sums),
 gaps AS (SELECT a.piece, a.i, a.j k, b.j, sqrt(sum((a.u-b.u)*(a.u-b.u))) d FROM units a JOIN units b ON a.piece=b.piece AND a.j=b.i AND a.pc=b.pc GROUP BY 1,2,3,4), {first}"""
        gain = "(SELECT d FROM gaps g WHERE g.piece=a.piece AND g.i=a.i AND g.k=a.j AND g.j=b.j)"
        pick = "min"
    for length in range(2, most + 1):
        steps.append(f"p{length - 1} AS (SELECT * FROM p{length - 2} UNION ALL SELECT a.piece, a.i, b.j, {pick}(a.v+b.v+{gain.format(L=length)}) FROM p{length - 2} a JOIN p{length - 2} b ON a.piece=b.piece AND a.j=b.i JOIN ends ON ends.piece=a.piece WHERE b.j-a.i={length} GROUP BY a.piece, a.i, b.j)")
    return ", ".join([base, *steps])


SCORES = f"""{NOTES}, scores AS (SELECT piece, work, (event_id%3)::int cfg, ((event_id//3)%2)::int seed, count(*) FILTER (WHERE value>=40) tp, count(*) FILTER (WHERE value>=20 AND value<40) fp, count(*) FILTER (WHERE value<20) fn FROM notes GROUP BY 1,2,3,4),
 rated AS (SELECT *, CASE WHEN tp+fp=0 THEN 0 ELSE tp/(tp+fp) END "precision", CASE WHEN tp+fn=0 THEN 0 ELSE tp/(tp+fn) END recall FROM scores),
 full_scores AS (SELECT *, CASE WHEN "precision"+recall=0 THEN 0 ELSE 2*"precision"*recall/("precision"+recall) END f1 FROM rated)"""


def cuts(gains: str, most: int, tie: str = "abs(2*k-i-j), k", pick: str = "max") -> str:
    """best(piece, i, j, v) and cut(piece, i, j, k) of the program over table gains(piece, i, k, j, g) and ends(piece, n).

    The program is unrolled by length, for pieces of at most `most` leaves.
    """
    steps = ["p1 AS MATERIALIZED (SELECT piece, i, i+1 j, 0.0::double v FROM (SELECT piece, unnest(range(n)) i FROM ends))"]
    for length in range(2, most + 1):
        steps.append(f"p{length} AS MATERIALIZED (SELECT * FROM p{length - 1} UNION ALL SELECT g.piece, g.i, g.j, {pick}(a.v+b.v+g.g) FROM {gains} g JOIN p{length - 1} a ON a.piece=g.piece AND a.i=g.i AND a.j=g.k JOIN p{length - 1} b ON b.piece=g.piece AND b.i=g.k AND b.j=g.j WHERE g.j-g.i={length} GROUP BY ALL)")
    return f"""{", ".join(steps)}, best AS (SELECT * FROM p{most}),
 opts AS (SELECT g.piece, g.i, g.k, g.j, a.v+b.v+g.g v FROM {gains} g JOIN best a ON a.piece=g.piece AND a.i=g.i AND a.j=g.k JOIN best b ON b.piece=g.piece AND b.i=g.k AND b.j=g.j),
 cut AS (SELECT piece, i, j, k FROM (SELECT * FROM opts QUALIFY v>={pick}(v) OVER (PARTITION BY piece, i, j)-1e-12) QUALIFY row_number() OVER (PARTITION BY piece, i, j ORDER BY {tie})=1)"""


#: split_(piece, i, k, j, m): the nodes that the chosen cuts reach from the whole piece, children before parents.
UNFOLD = """reached AS (SELECT piece, 0::bigint i, n::bigint j FROM ends UNION ALL SELECT r.piece, CASE WHEN side=0 THEN r.i ELSE k END, CASE WHEN side=0 THEN k ELSE r.j END FROM reached r JOIN cut c ON c.piece=r.piece AND c.i=r.i AND c.j=r.j CROSS JOIN (VALUES (0),(1)) x(side)),
 split_ AS (SELECT r.piece, r.i, k, r.j, row_number() OVER (PARTITION BY r.piece ORDER BY r.j, r.i DESC)-1 m FROM reached r JOIN cut c ON c.piece=r.piece AND c.i=r.i AND c.j=r.j)"""

#: triples(piece, i, k, j, x): affinity summed across each split of each interval.
TRIPLES = """ends AS (SELECT piece, max(leaf)+1 n FROM leaves GROUP BY 1), places AS (SELECT piece, n, unnest(range(n+1)) p FROM ends),
 corners AS (SELECT p.piece, p.p a, q.p b, coalesce(sum(aff),0) s FROM places p JOIN places q ON q.piece=p.piece AND q.p>=p.p LEFT JOIN aff f ON f.piece=p.piece AND f.i>=p.p AND f.j<q.p GROUP BY 1,2,3),
 triples AS (SELECT w.piece, w.a i, l.b k, w.b j, w.s-l.s-r.s x FROM corners w JOIN corners l ON l.piece=w.piece AND l.a=w.a JOIN corners r ON r.piece=w.piece AND r.a=l.b AND r.b=w.b WHERE l.b>w.a AND l.b<w.b)"""

#: placed(piece, node, parent, depth, first, last, split, m): the nodes of split_ and the leaves in preorder.
DEPTHS = """pre_ AS (SELECT *, row_number() OVER (PARTITION BY piece ORDER BY first, last DESC)-1 node FROM (SELECT piece, i AS first, j-1 AS last, k AS split, m FROM split_ UNION ALL SELECT piece, leaf, leaf, NULL, -1 FROM leaves WHERE piece IN (SELECT piece FROM ends))),
 placed AS (SELECT a.piece, a.node, max(b.node) parent, count(b.node) depth, any_value(a.first) AS first, any_value(a.last) AS last, any_value(a.split) split, any_value(a.m) m FROM pre_ a LEFT JOIN pre_ b ON b.piece=a.piece AND b.node<a.node AND b.first<=a.first AND b.last>=a.last GROUP BY 1,2)"""


def exact(distance: str = "sqrt(sum((a.u-b.u)*(a.u-b.u)))") -> str:
    """best, cut, split_ and nodes (as in balanced, with mean affinity `x`) of the exact program of affinities."""
    pairs = pair_distances().replace("sqrt(sum((a.u-b.u)*(a.u-b.u)))", distance)
    return f"""{pairs}, {TRIPLES}, gains AS (SELECT piece, i, k, j, (n-(j-i))*x g FROM triples JOIN ends USING(piece)), {cuts("gains", 8)}, {UNFOLD}, {DEPTHS},
 nodes AS (SELECT p.piece, first, last, depth, split, a.start_qb s, b.end_qb e, c.start_qb t, n, x/((k-i)*(j-k)) x FROM placed p JOIN ends USING(piece) JOIN leaves a ON a.piece=p.piece AND a.leaf=first JOIN leaves b ON b.piece=p.piece AND b.leaf=last LEFT JOIN leaves c ON c.piece=p.piece AND c.leaf=split LEFT JOIN triples f ON f.piece=p.piece AND i=first AND k=split AND j=last+1)"""


def merges(table: str, order: str) -> str:
    """split_ of repeated merges of the neighbours that come first in the order of table(piece, i, k, j, ...).

    c holds the edges of the clusters; a merge takes one out.
    """
    return f"""merge_ AS (SELECT piece, 0::bigint m, range(n+1) c, NULL::bigint i, NULL::bigint k, NULL::bigint j FROM ends
  UNION ALL SELECT piece, m+1, list_filter(c, lambda v: v<>k), i, k, j FROM (SELECT q.piece, q.m, q.c, g.i::bigint i, g.k::bigint k, g.j::bigint j FROM merge_ q JOIN {table} g ON g.piece=q.piece AND list_contains(q.c, g.i) AND list_position(q.c, g.k)=list_position(q.c, g.i)+1 AND list_position(q.c, g.j)=list_position(q.c, g.i)+2 QUALIFY row_number() OVER (PARTITION BY q.piece ORDER BY {order}, g.i)=1)),
 split_ AS (SELECT piece, i, k, j, m-1 m FROM merge_ WHERE m>0)"""


def node_table(mean: str = "NULL::double", objective: str = "NULL::double") -> str:
    """The node table of split_ over leaves; mean may use triples as f, objective best as o."""
    joins = " LEFT JOIN triples f ON f.piece=p.piece AND f.i=first AND f.k=split AND f.j=last+1" if "f." in mean else ""
    joins += " LEFT JOIN best o ON o.piece=p.piece AND parent IS NULL AND o.i=0 AND o.j=last+1" if "o." in objective else ""
    return f"""SELECT p.piece, node::int node, parent::int parent, depth::int AS depth, first::int AS first, last::int AS last, split::int AS split, round(a.start_qb,6)+0.0 AS start, round(b.end_qb,6)+0.0 AS "end", m::int merge_order, round({mean},6)+0.0 mean_affinity, round({objective},6)+0.0 objective, 'success' AS status
 FROM placed p JOIN leaves a ON a.piece=p.piece AND a.leaf=first JOIN leaves b ON b.piece=p.piece AND b.leaf=last{joins}"""


#: gaps(piece, i, k, j, d): distances between the summed neighbours [i, k) and [k, j).
SUMMED = """spans AS (SELECT a.piece, a.leaf i, b.leaf+1 j FROM leaves a JOIN leaves b ON a.piece=b.piece AND a.leaf<=b.leaf),
 sums AS (SELECT s.piece, i, j, pc, sum(v) v FROM spans s JOIN dense d ON d.piece=s.piece AND d.leaf>=i AND d.leaf<j GROUP BY 1,2,3,4), units AS (SELECT *, v/sum(v) OVER (PARTITION BY piece,i,j) u FROM sums),
 gaps AS (SELECT a.piece, a.i, a.j k, b.j, sqrt(sum((a.u-b.u)*(a.u-b.u))) d FROM units a JOIN units b ON a.piece=b.piece AND a.j=b.i AND a.pc=b.pc GROUP BY 1,2,3,4)"""


def greedy() -> str:
    """split_, placed and nodes (as in balanced, with merge order m) of greedy merges of the nearest neighbours."""
    return f"""{leaves()}, ends AS (SELECT piece, max(leaf)+1 n FROM leaves GROUP BY 1), {SUMMED}, {merges("gaps", "g.d")}, {DEPTHS}"""


#: leaves, pairs, aff, triples and con(piece, split, c) of embeddings in runs of 25.
SEQUENCES = f"""leaves AS (SELECT 's'||(vec_id//25) piece, (vec_id%25)::int leaf, (vec_id%25)::double start_qb, (vec_id%25+1)::double end_qb, embedding::double[] v FROM embeddings),
 pairs AS (SELECT a.piece, a.leaf i, b.leaf j, list_distance(a.v, b.v) d FROM leaves a JOIN leaves b ON a.piece=b.piece AND a.leaf<b.leaf), scales AS (SELECT piece, coalesce(median(d) FILTER (WHERE d>1e-12), 1.0) scale FROM pairs GROUP BY 1),
 aff AS (SELECT piece, i, j, exp(-0.5*(d/scale)*(d/scale)) aff FROM pairs JOIN scales USING(piece)), {TRIPLES},
 con AS (SELECT s.piece, s.leaf split, greatest(0, least(1, avg(d) FILTER (WHERE i<s.leaf AND j>=s.leaf) - (coalesce(avg(d) FILTER (WHERE j<s.leaf),0)+coalesce(avg(d) FILTER (WHERE i>=s.leaf),0))/2)) c FROM leaves s JOIN pairs p ON p.piece=s.piece AND i>=s.leaf-2 AND j<s.leaf+2 WHERE s.leaf>0 GROUP BY 1,2)"""

#: done(g, piece, tp, fp, fn, error, precision, recall, f1): matches in order, most first, then least distance, from
#: fits(g, piece, k, i, c), what prediction k may be matched with at which cost, and sides(g, piece, np, nr), their numbers.
MATCHED = """may AS (SELECT g, piece, k, i, c FROM fits UNION ALL SELECT g, piece, unnest(range(1, np+1)), NULL, 0 FROM sides),
 walk AS (SELECT g, piece, 0::bigint k, 0::bigint i, 0::bigint n, 0.0::double d FROM sides UNION ALL SELECT g, piece, k, i, s.n, s.d FROM (SELECT w.g, w.piece, m.k::bigint k, coalesce(m.i, w.i)::bigint i, min({'n': w.n-(m.i IS NOT NULL)::bigint, 'd': w.d+m.c}) s FROM walk w JOIN may m ON m.g=w.g AND m.piece=w.piece AND m.k=w.k+1 AND (m.i IS NULL OR m.i>w.i) GROUP BY ALL)),
 ended AS (SELECT g, piece, min({'n': n, 'd': d}) s FROM walk JOIN sides USING(g, piece) WHERE k=np GROUP BY 1,2),
 told AS (SELECT g, piece, (-s.n)::bigint tp, np+s.n fp, nr+s.n fn, CASE WHEN s.n<0 THEN s.d/-s.n END error FROM ended JOIN sides USING(g, piece)),
 rates AS (SELECT *, CASE WHEN tp+fp=0 THEN 0 ELSE tp/(tp+fp) END "precision", CASE WHEN tp+fn=0 THEN 0 ELSE tp/(tp+fn) END recall FROM told), done AS (SELECT *, CASE WHEN "precision"+recall=0 THEN 0 ELSE 2*"precision"*recall/("precision"+recall) END f1 FROM rates)"""

#: moved(piece, t, edge) from marks(piece, t), with repeats, and edges(piece, t): each of the shorter list at one of the
#: longer, in order, with the least total distance, leftmost; traced back from the last.
PROJECTED = """lists AS (SELECT piece, 1 kind, t, row_number() OVER (PARTITION BY piece ORDER BY t) k FROM marks UNION ALL SELECT piece, 0, t, row_number() OVER (PARTITION BY piece ORDER BY t) FROM (SELECT DISTINCT piece, t FROM edges)),
 counts_ AS (SELECT piece, count(*) FILTER (WHERE kind=1) nm, count(*) FILTER (WHERE kind=0) ne FROM lists GROUP BY 1 HAVING nm>0 AND ne>0),
 sided AS (SELECT l.piece, (kind=1)=(nm<=ne) short, t, k, least(nm, ne) n FROM lists l JOIN counts_ USING(piece)),
 cost_ AS (SELECT a.piece, a.k a, b.k b, a.n n, abs(a.t-b.t) c FROM sided a JOIN sided b ON b.piece=a.piece AND a.short AND NOT b.short),
 ahead AS (SELECT piece, a, b, n, c v FROM cost_ WHERE a=1 UNION ALL SELECT c.piece, c.a, c.b, c.n, min(f.v)+c.c FROM ahead f JOIN cost_ c ON c.piece=f.piece AND c.a=f.a+1 AND c.b>f.b GROUP BY c.piece, c.a, c.b, c.n, c.c),
 trace AS (SELECT piece, n a, arg_min(b, {'v': v, 'b': b}) b FROM ahead WHERE a=n GROUP BY 1,2 UNION ALL SELECT t.piece, t.a-1, arg_min(f.b, {'v': f.v, 'b': f.b}) FROM trace t JOIN ahead f ON f.piece=t.piece AND f.a=t.a-1 AND f.b<t.b GROUP BY 1,2),
 moved AS (SELECT r.piece, CASE WHEN nm<=ne THEN s.t ELSE l.t END t, CASE WHEN nm<=ne THEN l.t ELSE s.t END edge FROM trace r JOIN counts_ USING(piece) JOIN sided s ON s.piece=r.piece AND s.short AND s.k=r.a JOIN sided l ON l.piece=r.piece AND NOT l.short AND l.k=r.b)"""
