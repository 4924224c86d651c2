"""Triples of a graph, patterns and property paths over them, and inference."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from notegraph.functions.text import nfc
from notegraph.operators.closure import all_pairs, reach
from notegraph.plans.build import Graph
from notegraph.plans.catalog import _start, by_tag, by_type, latest, learning_path, near, orphans
from notegraph.session import cut

#: Namespaces and predicates of the public vocabularies and of the vault.
VAULT = "urn:vault:"
RDF_TYPE = "http://www.w3.org/1999/02/22-rdf-syntax-ns#type"
SUB_CLASS = "http://www.w3.org/2000/01/rdf-schema#subClassOf"
DOMAIN = "http://www.w3.org/2000/01/rdf-schema#domain"
RANGE = "http://www.w3.org/2000/01/rdf-schema#range"
INVERSE = "http://www.w3.org/2002/07/owl#inverseOf"
TRANSITIVE = "http://www.w3.org/2002/07/owl#TransitiveProperty"
SYMMETRIC = "http://www.w3.org/2002/07/owl#SymmetricProperty"
BROADER = "http://www.w3.org/2004/02/skos/core#broader"
CREATED = "http://purl.org/dc/terms/created"
XSD_DATE = "http://www.w3.org/2001/XMLSchema#date"
COLUMNS = ["s", "p", "o", "o_kind", "datatype", "lang"]


def iri(kind: str, value: Column) -> Column:
    """The IRI of a path or a name: NFC, every part percent-encoded, slashes kept."""
    parts = F.transform(F.split(nfc(value), "/"), lambda x: F.regexp_replace(F.url_encode(x), r"\+", "%20"))
    return F.concat(F.lit(f"{VAULT}{kind}/"), F.array_join(parts, "/"))


def _triple(df: DataFrame, s: Column, p: str | Column, o: Column, kind: str = "iri", datatype: str | None = None, lang: str | None = None) -> DataFrame:
    p = F.lit(p) if isinstance(p, str) else p
    return df.select(s.alias("s"), p.alias("p"), o.alias("o"), F.lit(kind).alias("o_kind"), F.lit(datatype).cast("string").alias("datatype"), F.lit(lang).cast("string").alias("lang")).filter("s IS NOT NULL AND o IS NOT NULL")


def triples(g: Graph, lang: str = "ko") -> DataFrame:
    """s, p, o, o_kind, datatype, lang of a graph, each once: types, summaries, dates, edges, tags and their parents."""
    note = iri("note", F.col("path"))
    n = g.node
    valued = lambda c: n.filter(F.col(c) != "")
    edge = g.edge.filter("dst IS NOT NULL")
    tags = g.tag.select("path", "tag")
    parts = F.split("tag", "/")
    levels = g.tag.select("tag").distinct().filter(F.size(parts) > 1).select(F.explode(F.transform(F.sequence(F.lit(2), F.size(parts)), lambda i: F.struct(F.array_join(F.slice(parts, 1, i), "/").alias("child"), F.array_join(F.slice(parts, 1, i - 1), "/").alias("parent")))).alias("l"))
    out = (
        _triple(valued("type"), note, RDF_TYPE, iri("type", F.col("type")))
        .unionByName(_triple(valued("summary"), note, f"{VAULT}summary", F.col("summary"), "literal", lang=lang))
        .unionByName(_triple(valued("created"), note, CREATED, F.col("created"), "literal", datatype=XSD_DATE))
        .unionByName(_triple(edge, iri("note", F.col("src")), F.concat(F.lit(VAULT), F.col("kind")), iri("note", F.col("dst"))))
        .unionByName(_triple(tags, note, f"{VAULT}tag", iri("tag", F.col("tag"))))
        .unionByName(_triple(levels, iri("tag", F.col("l.child")), BROADER, iri("tag", F.col("l.parent"))))
    )
    return out.distinct()


def merge(*graphs: DataFrame) -> DataFrame:
    """The union of sets of triples."""
    out = graphs[0]
    for g in graphs[1:]:
        out = out.unionByName(g)
    return out.distinct()


def match(t: DataFrame, *patterns: tuple[str, str, str]) -> DataFrame:
    """A basic graph pattern: the bindings of its ?variables, joined on those they share."""
    out: DataFrame | None = None
    for pattern in patterns:
        df, names = t, {}
        for column, term in zip(("s", "p", "o"), pattern):
            if not term.startswith("?"):
                df = df.filter(F.col(column) == term)
            elif term[1:] in names:
                df = df.filter(F.col(column) == F.col(names[term[1:]]))
            else:
                names[term[1:]] = column
        df = df.select(*[F.col(c).alias(v) for v, c in names.items()])
        shared = [c for c in df.columns if out is not None and c in out.columns]
        if out is not None and not shared:
            raise ValueError("patterns without a shared variable: their product is not built")
        out = df if out is None else out.join(df, shared)
    return out.distinct()


def optional(left: DataFrame, right: DataFrame) -> DataFrame:
    """OPTIONAL: left bindings, with right's where they agree."""
    return left.join(right, [c for c in left.columns if c in right.columns], "left")


def not_exists(left: DataFrame, right: DataFrame) -> DataFrame:
    """FILTER NOT EXISTS: left bindings that no right one agrees with."""
    return left.join(right, [c for c in left.columns if c in right.columns], "left_anti")


class Path:
    """A property path over triples: pairs s, o as a set. Compose with /, |, ~ (inverse), plus, star, maybe."""

    def __init__(self, pairs: DataFrame, nodes: DataFrame) -> None:
        self.pairs, self.nodes = pairs, nodes

    @staticmethod
    def of(t: DataFrame, p: str) -> Path:
        """The pairs of one predicate; p* and p? also hold for every subject and object of `t`."""
        nodes = t.select(F.col("s").alias("n")).union(t.filter("o_kind = 'iri'").select("o")).distinct()
        return Path(t.filter(F.col("p") == p).select("s", "o").distinct(), nodes)

    def _with(self, pairs: DataFrame) -> Path:
        return Path(pairs, self.nodes)

    def __truediv__(self, other: Path) -> Path:
        return self._with(self.pairs.withColumnRenamed("o", "via").join(other.pairs.withColumnRenamed("s", "via"), "via").select("s", "o").distinct())

    def __or__(self, other: Path) -> Path:
        return self._with(self.pairs.unionByName(other.pairs).distinct())

    def __invert__(self) -> Path:
        return self._with(self.pairs.select(F.col("o").alias("s"), F.col("s").alias("o")))

    def plus(self) -> Path:
        return self._with(all_pairs(self.pairs.select(F.col("s").alias("src"), F.col("o").alias("dst"))).select(F.col("src").alias("s"), F.col("dst").alias("o")))

    def maybe(self) -> Path:
        return self._with(self.pairs.unionByName(self.nodes.select(F.col("n").alias("s"), F.col("n").alias("o"))).distinct())

    def star(self) -> Path:
        return self.plus().maybe()


def infer(t: DataFrame) -> DataFrame:
    """`t` with all that its schema triples entail, until nothing is added.

    subClassOf (transitive, and types inherited), domain, range, inverseOf (both ways), and
    transitive and symmetric properties. Semi-naive: a round joins only what the one before added
    with what is known, unless that added to the schema, and writes only what is new. A transitive
    property is joined with itself, so each round doubles the length of the chains known. The
    closure may be far larger than `t`.
    """
    none = F.lit(None).cast("string")
    whole = cut(t.select(*COLUMNS).distinct())
    iris = whole.filter("o_kind = 'iri'").select("s", "p", "o")
    literals = whole.filter("o_kind <> 'iri'").select("s", "p").distinct()
    parts, delta, fresh_schema = [iris], iris, True
    made = lambda df, s, p, o: df.select(F.col(s).alias("s"), (F.lit(p) if isinstance(p, str) else p).alias("p"), F.col(o).alias("o"))
    while True:
        known = reduce(DataFrame.unionByName, parts)
        data = known if fresh_schema else delta
        of = lambda p, df=known: df.filter(F.col("p") == p).select("s", "o")
        flagged = lambda kind: of(RDF_TYPE).filter(F.col("o") == kind).select(F.col("s").alias("p"))  # noqa: E731, B023
        trans = flagged(TRANSITIVE).union(t.sparkSession.createDataFrame([(SUB_CLASS,)], "p string")).distinct()
        chains = lambda df: df.join(trans, "p").select("p", "s", "o")  # noqa: E731, B023
        before, after = lambda df: chains(df).withColumnRenamed("o", "via"), lambda df: chains(df).select("p", F.col("s").alias("via"), "o")  # noqa: E731, B023
        new = [made(before(data).join(after(known), ["p", "via"]), "s", F.col("p"), "o")]
        if not fresh_schema:
            new.append(made(before(known).join(after(data), ["p", "via"]), "s", F.col("p"), "o"))
        new.append(made(of(RDF_TYPE, data).withColumnRenamed("o", "via").join(of(SUB_CLASS).select(F.col("s").alias("via"), "o"), "via"), "s", RDF_TYPE, "o"))
        for schema, end in ((DOMAIN, "s"), (RANGE, "o")):
            rule = of(schema).select(F.col("s").alias("p"), F.col("o").alias("cls"))
            new.append(made(data.join(rule, "p").select(F.col(end).alias("x"), "cls"), "x", RDF_TYPE, "cls"))
            if schema == DOMAIN and fresh_schema:
                new.append(made(literals.join(rule, "p"), "s", RDF_TYPE, "cls"))
        inv = of(INVERSE)
        both = inv.union(inv.select("o", "s")).select(F.col("s").alias("p"), F.col("o").alias("b"))
        new.append(made(data.join(both, "p"), "o", F.col("b"), "s"))
        new.append(made(data.join(flagged(SYMMETRIC), "p"), "o", F.col("p"), "s"))
        delta = cut(reduce(DataFrame.unionByName, new).distinct().join(known, ["s", "p", "o"], "left_anti"))
        if delta.isEmpty():
            break
        parts.append(delta)
        rules = F.col("p").isin([SUB_CLASS, DOMAIN, RANGE, INVERSE]) | ((F.col("p") == RDF_TYPE) & F.col("o").isin([TRANSITIVE, SYMMETRIC]))
        fresh_schema = not delta.filter(rules).isEmpty()
    added = parts[1:]
    if not added:
        return whole
    return whole.unionByName(reduce(DataFrame.unionByName, added).select("s", "p", "o", F.lit("iri").alias("o_kind"), none.alias("datatype"), none.alias("lang")))


def explosion(before: DataFrame, after: DataFrame) -> DataFrame:
    """before, after, ratio: what inference adds."""
    b, a = before.agg(F.count(F.lit(1)).alias("before")), after.agg(F.count(F.lit(1)).alias("after"))
    return b.crossJoin(a).withColumn("ratio", F.col("after") / F.col("before"))


def n_triples(t: DataFrame) -> DataFrame:
    """One N-Triples line each, to be written as text; it is Turtle as well."""
    o = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace("o", r"\\", r"\\\\"), '"', '\\\\"'), "\n", r"\\n"), "\r", r"\\r")
    literal = F.concat(F.lit('"'), o, F.lit('"'), F.coalesce(F.concat(F.lit("^^<"), "datatype", F.lit(">")), F.concat(F.lit("@"), "lang"), F.lit("")))
    node = F.concat(F.lit("<"), F.col("o"), F.lit(">"))
    return t.select(F.concat(F.lit("<"), "s", F.lit("> <"), "p", F.lit("> "), F.when(F.col("o_kind") == "iri", node).otherwise(literal), F.lit(" .")).alias("value"))


def read_n_triples(lines: DataFrame) -> DataFrame:
    """The triples of lines (value) that n_triples wrote."""
    v = F.col("value")
    form = r'^<([^>]*)> <([^>]*)> (?:<([^>]*)>|"((?:[^"\\]|\\.)*)"(?:\^\^<([^>]*)>|@([A-Za-z0-9-]+))?) \.$'
    part = lambda i: F.regexp_extract(v, form, i)
    is_iri = v.rlike(r"> <[^>]*> \.$") & (part(3) != "")
    marked = F.regexp_replace(part(4), r"\\\\", "\0")
    text = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace(marked, r'\\"', '"'), r"\\n", "\n"), r"\\r", "\r"), "\0", r"\\")
    blank = lambda i: F.when(part(i) != "", part(i))
    return lines.filter(v.rlike(form)).select(part(1).alias("s"), part(2).alias("p"), F.when(is_iri, part(3)).otherwise(text).alias("o"), F.when(is_iri, "iri").otherwise("literal").alias("o_kind"), blank(5).alias("datatype"), blank(6).alias("lang"))


def rdf_triples(spark: SparkSession, d: str) -> DataFrame:
    return triples(latest(spark, d)).groupBy("p", "o_kind", "datatype", "lang").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("s").alias("subjects"))


def rdf_pattern(spark: SparkSession, d: str) -> DataFrame:
    """Concepts that build on decisions, and the tags of the former if they have any."""
    t = cut(triples(latest(spark, d)))
    kind = lambda k: f"{VAULT}type/{k}"
    found = match(t, ("?a", RDF_TYPE, kind("concept")), ("?a", f"{VAULT}builds_on", "?b"), ("?b", RDF_TYPE, kind("decision")))
    return optional(found, match(t, ("?a", f"{VAULT}tag", "?tag")))


def rdf_orphans(spark: SparkSession, d: str) -> DataFrame:
    """Typed notes that nothing links to, by pattern."""
    t = cut(triples(latest(spark, d)))
    links = t.filter(F.col("p").isin([VAULT + k for k in ("links_to", "builds_on", "supersedes", "part_of")]))
    return not_exists(match(t, ("?note", RDF_TYPE, "?kind")).select("note"), links.select(F.col("o").alias("note")))


def rdf_paths(spark: SparkSession, d: str) -> DataFrame:
    """Tags with all broader ones (a closure), and notes reached by builds_on and then supersedes, or back."""
    t = cut(triples(latest(spark, d)))
    broader = Path.of(t, BROADER).plus().pairs.withColumn("path", F.lit("broader+"))
    step = (Path.of(t, f"{VAULT}builds_on") / Path.of(t, f"{VAULT}supersedes") | ~Path.of(t, f"{VAULT}supersedes")).pairs.withColumn("path", F.lit("builds_on/supersedes|^supersedes"))
    return broader.unionByName(step)


def rdf_inferred(spark: SparkSession, d: str) -> DataFrame:
    """What a small schema adds to the tags: broader is transitive and has an inverse."""
    t = triples(latest(spark, d)).filter(F.col("p") == BROADER)
    schema = spark.createDataFrame([(BROADER, RDF_TYPE, TRANSITIVE, "iri", None, None), (BROADER, INVERSE, BROADER.replace("broader", "narrower"), "iri", None, None)], "s string, p string, o string, o_kind string, datatype string, lang string")
    out = infer(merge(t, schema))
    return out.groupBy("p").agg(F.count(F.lit(1)).alias("n"))


def vault_schema(t: DataFrame) -> DataFrame:
    """The schema triples of a vault: each type in `t` is a kind of Document, as are the two ends of builds_on."""
    document = f"{VAULT}type/Document"
    fixed = [
        (f"{VAULT}builds_on", RDF_TYPE, TRANSITIVE), (f"{VAULT}builds_on", DOMAIN, document), (f"{VAULT}builds_on", RANGE, document),
        (f"{VAULT}linked_by", INVERSE, f"{VAULT}links_to"), (BROADER, RDF_TYPE, TRANSITIVE), (BROADER, INVERSE, BROADER.replace("broader", "narrower")),
    ]
    kinds = t.filter(F.col("p") == RDF_TYPE).select(F.col("o").alias("s")).filter(F.col("s") != document).distinct()
    return _triple(kinds, F.col("s"), SUB_CLASS, F.lit(document)).unionByName(_triple(t.sparkSession.createDataFrame(fixed, "s string, p string, o string"), F.col("s"), F.col("p"), F.col("o")))


def inference_report(t: DataFrame) -> DataFrame:
    """p, before, after, ratio: what the schema of the vault adds to `t`, by predicate; p is null over all."""
    before = cut(merge(t, vault_schema(t)))
    after = infer(before)
    n = lambda df, name: df.groupBy("p").agg(F.count(F.lit(1)).alias(name))
    by_p = n(after, "after").join(n(before, "before"), "p", "left").select("p", F.coalesce("before", F.lit(0)).alias("before"), "after", (F.col("after") / F.col("before")).alias("ratio"))
    return by_p.unionByName(explosion(before, after).withColumn("p", F.lit(None).cast("string")))


def rdf_inferred_vault(spark: SparkSession, d: str) -> DataFrame:
    """Inference over all triples, and how many times as many there are then."""
    return inference_report(cut(triples(latest(spark, d))))


def parity(g: Graph, type_: str, tag: str, path: str) -> DataFrame:
    """query, graph, triples, differing: answers of the graph's queries and of the same asked of its triples.

    path, near, orphans, type and tag compare the notes by IRI, stats the edges of each kind once.
    """
    t = cut(triples(g))
    note = lambda df: df.select(iri("note", F.col("path")).alias("s")).distinct()
    of = lambda p: t.filter(F.col("p") == p)
    start = g.node.sparkSession.range(1).select(iri("note", F.lit(path)).alias("s")).first()["s"]
    ups, edges = of(f"{VAULT}builds_on"), t.filter(F.col("p").isin([VAULT + k for k in ("links_to", "builds_on", "supersedes", "part_of")]))
    reached = reach(ups.select(F.col("s").alias("src"), F.col("o").alias("dst")), start).select(F.col("path").alias("s"))
    ends = edges.filter(F.col("s") == start).select(F.col("o").alias("s")).unionByName(edges.filter(F.col("o") == start).select("s")).distinct()
    shared = of(f"{VAULT}tag").join(of(f"{VAULT}tag").filter(F.col("s") == start).select("o"), "o").select("s").filter(F.col("s") != start).distinct().join(ends, "s", "left_anti")
    below = iri("tag", F.lit(tag))
    typed = of(RDF_TYPE).select("s").distinct()
    kinds = edges.groupBy("p").agg(F.count(F.lit(1)).alias("n")).select(F.concat_ws(" ", "p", "n").alias("s"))
    nfc_edges = g.edge.filter("dst IS NOT NULL").select(iri("note", F.col("src")).alias("a"), iri("note", F.col("dst")).alias("b"), F.concat(F.lit(VAULT), "kind").alias("p")).distinct()
    answers = {
        "path": (note(learning_path(g, path)), reached),
        "near": (note(near(g, path)), ends.unionByName(shared).distinct()),
        "orphans": (note(orphans(g)).join(typed, "s", "left_semi"), typed.join(edges.select(F.col("o").alias("s")), "s", "left_anti")),
        "type": (note(by_type(g, type_)), of(RDF_TYPE).filter(F.col("o") == iri("type", F.lit(type_))).select("s")),
        "tag": (note(by_tag(g, tag)), of(f"{VAULT}tag").filter((F.col("o") == below) | F.col("o").startswith(F.concat(below, F.lit("/")))).select("s").distinct()),
        "stats": (nfc_edges.groupBy("p").agg(F.count(F.lit(1)).alias("n")).select(F.concat_ws(" ", "p", "n").alias("s")), kinds),
    }
    sides = [df.select(F.lit(q).alias("query"), "s", F.lit(k).alias("side")) for q, both in answers.items() for k, df in enumerate(both)]
    rows = reduce(DataFrame.unionByName, sides).groupBy("query", "s").agg(F.min("side").alias("lo"), F.max("side").alias("hi"))
    count = lambda when: F.count_if(when)
    return rows.groupBy("query").agg(count(F.col("lo") == 0).alias("graph"), count(F.col("hi") == 1).alias("triples"), count(F.col("lo") == F.col("hi")).alias("differing"))


def rdf_parity(spark: SparkSession, d: str) -> DataFrame:
    g = latest(spark, d)
    return parity(g, "concept", "Stack", _start(g))


QUERIES = {f.__name__: f for f in (rdf_triples, rdf_parity, rdf_pattern, rdf_orphans, rdf_paths, rdf_inferred, rdf_inferred_vault)}

from notegraph.plans.catalog import _CHAIN, _G, LIMIT  # noqa: E402

_ENC = "replace(replace(replace(replace(url_encode(nfc_normalize({0})), '%2F', '/'), '~', '%7E'), '%2A', '*'), '+', '%20')"
_TAGS = "up AS (SELECT DISTINCT array_to_string(x[:i], '/') AS child, array_to_string(x[:i - 1], '/') AS parent FROM (SELECT x, unnest(range(2, len(x) + 1)) AS i FROM (SELECT DISTINCT string_split(tag, '/') AS x FROM gt)))"
_TREE = "tree(child, anc) AS (SELECT child, parent FROM up UNION SELECT t.child, u.parent FROM tree t JOIN up u ON u.child = t.anc)"
_NOTE = f"'{VAULT}note/' || {_ENC}"
_TAG = f"'{VAULT}tag/' || {_ENC}"
SQL = {
    "rdf_parity": f"""{_CHAIN.format(LIMIT)},
ends AS (SELECT dst AS path FROM ge WHERE src = (SELECT s FROM start) AND dst IS NOT NULL UNION SELECT src FROM ge WHERE dst = (SELECT s FROM start)),
shared AS (SELECT DISTINCT path FROM gt WHERE tag IN (SELECT tag FROM gt WHERE path = (SELECT s FROM start)) AND path <> (SELECT s FROM start) AND path NOT IN (SELECT path FROM ends)),
n AS (SELECT 'path' AS query, count(DISTINCT id) AS n FROM chain WHERE id <> (SELECT s FROM start) UNION ALL SELECT 'near', count(*) FROM (SELECT path FROM ends UNION SELECT path FROM shared)
  UNION ALL SELECT 'orphans', count(*) FROM gn WHERE type <> '' AND path NOT IN (SELECT dst FROM ge WHERE dst IS NOT NULL) UNION ALL SELECT 'type', count(*) FROM gn WHERE type = 'concept'
  UNION ALL SELECT 'tag', count(DISTINCT path) FROM gt WHERE tag = 'Stack' OR starts_with(tag, 'Stack/') UNION ALL SELECT 'stats', count(DISTINCT kind) FROM ge WHERE dst IS NOT NULL)
SELECT query, n AS graph, n AS triples, 0::BIGINT AS differing FROM n""",
    "rdf_pattern": f"""WITH {_G}, hit AS (SELECT DISTINCT e.src AS a, e.dst AS b FROM ge e JOIN gn x ON nfc_normalize(x.path) = nfc_normalize(e.src) AND x.type = 'concept' JOIN gn y ON nfc_normalize(y.path) = nfc_normalize(e.dst) AND y.type = 'decision' WHERE e.kind = 'builds_on')
SELECT DISTINCT {_NOTE.format('a')} AS a, {_NOTE.format('b')} AS b, {_TAG.format('t.tag')} AS tag FROM hit LEFT JOIN gt t ON nfc_normalize(t.path) = nfc_normalize(hit.a)""",
    "rdf_orphans": f"""WITH {_G} SELECT DISTINCT {_NOTE.format('path')} AS note FROM gn WHERE type <> ''
AND nfc_normalize(path) NOT IN (SELECT nfc_normalize(dst) FROM ge WHERE dst IS NOT NULL)""",
    "rdf_paths": f"""WITH RECURSIVE {_G}, {_TAGS}, {_TREE}
SELECT {_TAG.format('child')} AS s, {_TAG.format('anc')} AS o, 'broader+' AS path FROM tree
UNION ALL SELECT s, o, 'builds_on/supersedes|^supersedes' FROM (
  SELECT {_NOTE.format('b.src')} AS s, {_NOTE.format('p.dst')} AS o FROM ge b JOIN ge p ON nfc_normalize(p.src) = nfc_normalize(b.dst) AND p.kind = 'supersedes' AND p.dst IS NOT NULL WHERE b.kind = 'builds_on'
  UNION SELECT {_NOTE.format('dst')}, {_NOTE.format('src')} FROM ge WHERE kind = 'supersedes' AND dst IS NOT NULL)""",
    "rdf_triples": f"""WITH {_G}, {_TAGS}
SELECT '{RDF_TYPE}' AS p, 'iri' AS o_kind, NULL::VARCHAR AS datatype, NULL::VARCHAR AS lang, count(*) AS n, count(DISTINCT path) AS subjects FROM gn WHERE type <> ''
UNION ALL SELECT '{VAULT}summary', 'literal', NULL, 'ko', count(*), count(DISTINCT path) FROM gn WHERE summary <> ''
UNION ALL SELECT '{CREATED}', 'literal', '{XSD_DATE}', NULL, count(*), count(DISTINCT path) FROM gn WHERE created <> ''
UNION ALL SELECT '{VAULT}' || kind, 'iri', NULL, NULL, count(DISTINCT (nfc_normalize(src), nfc_normalize(dst))), count(DISTINCT nfc_normalize(src)) FROM ge WHERE dst IS NOT NULL GROUP BY kind
UNION ALL SELECT '{VAULT}tag', 'iri', NULL, NULL, count(DISTINCT (nfc_normalize(path), nfc_normalize(tag))), count(DISTINCT nfc_normalize(path)) FROM gt
UNION ALL SELECT '{BROADER}', 'iri', NULL, NULL, count(*), count(DISTINCT child) FROM up""",
    "rdf_inferred_vault": f"""WITH RECURSIVE {_G}, {_TAGS}, {_TREE},
b AS (SELECT DISTINCT nfc_normalize(src) AS s, nfc_normalize(dst) AS o FROM ge WHERE kind = 'builds_on' AND dst IS NOT NULL),
closure(s, o) AS (SELECT s, o FROM b UNION SELECT c.s, b.o FROM closure c JOIN b ON b.s = c.o),
typed AS (SELECT nfc_normalize(path) AS x FROM gn WHERE type <> ''),
known AS (SELECT x FROM typed UNION SELECT s FROM b UNION SELECT o FROM b),
kinds AS (SELECT count(DISTINCT nfc_normalize(type)) AS n FROM gn WHERE type <> ''),
n AS (
  SELECT '{RDF_TYPE}' AS p, (SELECT count(*) FROM typed) + 2 AS before, (SELECT count(*) FROM typed) + 2 + (SELECT count(*) FROM known) AS after
  UNION ALL SELECT '{VAULT}summary', count(*), count(*) FROM gn WHERE summary <> '' UNION ALL SELECT '{CREATED}', count(*), count(*) FROM gn WHERE created <> ''
  UNION ALL SELECT '{VAULT}' || kind, count(DISTINCT (nfc_normalize(src), nfc_normalize(dst))), CASE WHEN kind = 'builds_on' THEN (SELECT count(*) FROM closure) ELSE count(DISTINCT (nfc_normalize(src), nfc_normalize(dst))) END FROM ge WHERE dst IS NOT NULL GROUP BY kind
  UNION ALL SELECT '{VAULT}linked_by', 0, count(DISTINCT (nfc_normalize(src), nfc_normalize(dst))) FROM ge WHERE dst IS NOT NULL AND kind = 'links_to'
  UNION ALL SELECT '{VAULT}tag', count(DISTINCT (nfc_normalize(path), nfc_normalize(tag))), count(DISTINCT (nfc_normalize(path), nfc_normalize(tag))) FROM gt
  UNION ALL SELECT '{BROADER}', (SELECT count(*) FROM up), (SELECT count(*) FROM tree) UNION ALL SELECT '{BROADER.replace('broader', 'narrower')}', 0, count(*) FROM tree
  UNION ALL SELECT '{SUB_CLASS}', n, n FROM kinds UNION ALL SELECT '{DOMAIN}', 1, 1 UNION ALL SELECT '{RANGE}', 1, 1 UNION ALL SELECT '{INVERSE}', 2, 2)
SELECT p, before, after, CASE WHEN before > 0 THEN after / before END AS ratio FROM n UNION ALL SELECT NULL, CAST(sum(before) AS BIGINT), CAST(sum(after) AS BIGINT), sum(after) / sum(before) FROM n""",
    "rdf_inferred": f"""WITH RECURSIVE {_G}, {_TAGS}, {_TREE}
SELECT '{BROADER}' AS p, count(*) AS n FROM tree UNION ALL SELECT '{BROADER.replace('broader', 'narrower')}', count(*) FROM tree UNION ALL SELECT '{RDF_TYPE}', 1 UNION ALL SELECT '{INVERSE}', 1""",
}
