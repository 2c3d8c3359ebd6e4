"""File sources and sinks: XML, JSON, CSV, wiki markup, triples and tables."""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from eventloom.fixed_values import LIST_SEPARATOR, TECHNICAL_KEYS
from eventloom.functions.text import resolve_entities
from eventloom.operators.quality import upsert
from eventloom.session import stage
from eventloom.sources import cutting, plain_xml, records, schemas, turtle


# -- XML ------------------------------------------------------------------------------


def read_xml(spark: SparkSession, path: str, row_tag: str, schema: str, named_entities: bool = False) -> DataFrame:
    """Records of one tag from XML files of any size.

    Records are outermost elements of the tag, however deep they lie and whatever they hold;
    see :mod:`eventloom.sources.cutting`. ``row_tag`` is written as in the file, with its prefix
    if it has one. ``named_entities`` resolves entities a document type declares, such as
    ``&uuml;``, which the parser of a record does not know.
    """
    dense = cutting.small_files(spark, path)
    record = cutting.cut(spark, path, partial(cutting.Elements, row_tag=row_tag, dense=dense))
    text = resolve_entities(F.col("text")) if named_entities else F.col("text")
    return plain_xml.parse(record.select(text.alias("text")), schema, {"ignoreNamespace": "true", "rowTag": row_tag}).select("r.*")


def _own_text(value: Column) -> Column:
    """Text before the first inner tag."""
    return F.regexp_replace(value, "(?s)<.*$", "")


def xml_records(spark: SparkSession, path: str, delimiter: str = ",", root: str = "dblp") -> DataFrame:
    """All records of a bibliography dump: ``kind``, attributes, repeated tags joined.

    Records are the elements inside the one named ``root``, or the outermost ones of a file
    without it. A huge dump is cut inside its splits; see :mod:`eventloom.sources.cutting`.
    """
    found = cutting.cut(spark, path, partial(cutting.Elements, root=root)).withColumn("kind", F.regexp_extract("text", r"^<([^\s/>]+)", 1))
    # the outer tag gets one name for all kinds
    renamed = F.concat(F.lit("<record"), F.col("text").substr(F.length("kind") + 2, F.length("text")))
    record = F.regexp_replace(renamed, r"</[^<>]*>$", "</record>")
    parsed = found.select("kind", F.from_xml(resolve_entities(record), schemas.BIBLIOGRAPHY, {"rowTag": "record"}).alias("r"))
    joined = [
        F.when(F.col(f"r.`{tag}`").isNotNull(), F.concat_ws(delimiter, F.transform(f"r.`{tag}`", _own_text))).alias(tag) for tag in schemas.BIBLIOGRAPHY_TAGS
    ]
    return parsed.select("kind", *[F.col(f"r._{name}").alias(name) for name in schemas.BIBLIOGRAPHY_ATTRIBUTES], *joined)


def xml_kinds(spark: SparkSession, path: str, kinds: list[str], delimiter: str = ",", root: str = "dblp") -> dict[str, DataFrame]:
    """One table per record tag of a bibliography dump, all from one reading of it."""
    found = stage(xml_records(spark, path, delimiter, root), "kinds")
    return {kind: found.where(F.col("kind") == kind).drop("kind") for kind in kinds}


def hits(found: Column) -> Column:
    """Values found for a property: none is null, one is itself, several are a stored list."""
    kept = F.filter(found, lambda v: v.isNotNull())
    # inside a list of one, so that the values are looked for once
    return F.get(F.transform(F.array(kept), lambda k: F.when(F.size(k) > 0, F.array_join(k, LIST_SEPARATOR))), F.lit(0))


def with_attribute(found: Column, attribute: str, value: str, field: str = "_VALUE") -> Column:
    """Field of the elements whose attribute has the value."""
    return F.transform(F.filter(found, lambda e: e[attribute] == value), lambda e: e[field])


def xml_entities(spark: SparkSession, path: str, row_tag: str, schema: str, properties: dict[str, Column]) -> DataFrame:
    """Records of a tag with one column per property; see :func:`hits` for repeated values."""
    return read_xml(spark, path, row_tag, schema).select(*[hits(c).alias(name) for name, c in properties.items()])


def catalogue_properties() -> dict[str, Column]:
    """The properties read from a library catalogue document."""

    def col(path: str) -> Column:
        return F.col(path)

    identifiers = col("identifiers.identifier")
    creators = col("corporateCreator")

    def creator_ids(of: Column) -> Column:
        return F.flatten(F.transform(of, lambda c: F.coalesce(
            with_attribute(c["corporateIDs"]["corporateID"], "_type", "gnd"), F.array().cast("array<string>"))))

    def of_type(kind: str) -> Column:
        return F.filter(creators, lambda c: c["_type"] == kind)

    def codes(kind: str) -> Column:
        return F.flatten(with_attribute(col("classificationInfo.classifications.classification"), "_classificationName", kind, "code"))

    properties = {
        "databaseDate": col("systemInfo.databaseDate"),
        "changeDate": col("systemInfo.changeDate"),
        "ftxCreationDate": col("systemInfo.ftxCreationDate"),
        "documentGenreCode": col("formalInfo.documentGenreCode"),
        "documentTypeCode": col("formalInfo.documentTypeCode"),
        "documentId": col("systemInfo.documentID"),
    }
    for kind in ("ppn", "firstid", "isbn", "isbn13", "ean", "doi"):
        properties[kind] = with_attribute(identifiers, "_type", kind)
    properties.update(
        {
            "corporateCreatorTypes": F.transform(creators, lambda c: c["_type"]),
            "corporateCreatorNames": F.flatten(F.transform(creators, lambda c: c["name"])),
            "gndIds": creator_ids(creators),
            "authorGndId": creator_ids(of_type("author")),
            "sponsorGndId": creator_ids(of_type("sponsor")),
            "title": col("bibliographicInfo.title"),
            "alternativeTitles": col("bibliographicInfo.alternativeTitles.alternative"),
            "event": col("conferenceInfo.name"),
            "location": col("conferenceInfo.places.place"),
            "dates": col("conferenceInfo.dates.date"),
            "description": col("conferenceInfo.description"),
            "pubyear": col("bibliographicInfo.publicationInfo.issued"),
            "pubplace": col("bibliographicInfo.publicationInfo.publicationPlaces.publicationPlace"),
            "publisher": col("bibliographicInfo.publicationInfo.publisher"),
            "journalTitle": col("journalInfo.title"),
            "journalVolumeNumber": col("journalInfo.volumeNumber"),
            "bk": codes("bk"),
            "ddc": codes("ddc"),
        }
    )
    return properties


def catalogue_documents(spark: SparkSession, path: str, row_tag: str = "document") -> DataFrame:
    return xml_entities(spark, path, row_tag, schemas.CATALOGUE_DOCUMENT, catalogue_properties())


def proceedings_volumes(spark: SparkSession, path: str, row_tag: str = "volume") -> DataFrame:
    properties = {c: F.col(c) for c in ("title", "shortTitle", "date", "location")}
    properties |= {c: F.col(f"conference.{c}") for c in ("dblp", "website")}
    return xml_entities(spark, path, row_tag, schemas.VOLUME, properties)


# -- JSON -----------------------------------------------------------------------------


def read_json(spark: SparkSession, path: str, schema: str, multi_line: bool = False) -> DataFrame:
    """JSON files; one document per line is splittable, ``multi_line`` reads whole files."""
    return spark.read.schema(schema).option("multiLine", str(multi_line).lower()).json(path)


def work_pages(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    """Items of all response pages with status ``ok``."""
    pages = read_json(spark, path, schemas.WORK_PAGE, multi_line).where("status = 'ok'")
    return pages.select(F.explode("message.items").alias("item")).select("item.*")


def work_titles(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    """All titles of all pages, empty ones dropped."""
    items = work_pages(spark, path, multi_line)
    return items.select(F.explode("title").alias("title")).where("title <> ''")


def conference_list(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    """Records of JSON arrays of conferences."""
    return read_json(spark, path, schemas.CONFERENCE, multi_line)


def crawl_batches(spark: SparkSession, path: str) -> DataFrame:
    """All crawled batch files with the file each record came from."""
    return read_json(spark, path, schemas.CALL).withColumn("batchFile", F.input_file_name())


def library_search(spark: SparkSession, path: str, title_part: str, acronym: str) -> DataFrame:
    """Catalogue events whose title contains a text and whose conference name starts with ``acronym ;``."""
    raw = read_json(spark, path, schemas.LIBRARY_EVENT).select("event.*")
    name = F.col("bib.conferenceInfo.name")
    found = raw.where(F.col("bib.title").contains(title_part) & name.startswith(f"{acronym} ;"))

    def identifier(kind: str) -> Column:
        return F.get(with_attribute(F.col("ids"), "@type", kind, "#text"), F.lit(0)).alias(kind)

    day = F.col("bib.conferenceInfo.dates.`dc:date`")
    return found.select(
        F.col("bib.title").alias("title"),
        F.col("bib.alternativeTitles").alias("alternativeTitles"),
        name.alias("event"),
        F.col("bib.conferenceInfo.`dc:description`").alias("desc"),
        F.get(day, F.lit(0)).alias("starttime"),
        F.get(day, F.lit(1)).alias("endtime"),
        F.col("bib.conferenceInfo.places.place").alias("location"),
        *[F.col(f"bib.{c}").alias(c) for c in ("pubyear", "pubplace", "publisher")],
        F.get(with_attribute(F.col("fields"), "@classificationName", "bk", "code"), F.lit(0)).alias("bk"),
        *[identifier(k) for k in ("ppn", "isbn13", "doi", "firstid")],
    )


def simplify_result(results: DataFrame) -> DataFrame:
    """Ten fields of a lookup result over several sources."""
    names = {
        "source": "source", "year": "year", "ordinal": "ordinal", "title": "title", "eventId": "eventId",
        "regionIso": "region", "countryIso": "country", "cityWikidataid": "city", "city": "cityLabel", "url": "url",
    }
    return results.select(
        *[(F.col(c) if c in results.columns else F.lit(None).cast("string")).alias(a) for c, a in names.items()]
    )


def write_by_source(results: DataFrame, path: str) -> None:
    """Result records as JSON in one folder per source."""
    results.write.partitionBy("source").json(path)


def write_lookup(lookup: DataFrame, path: str) -> None:
    """A lookup dictionary as JSON."""
    lookup.write.json(path)


# -- CSV and tables -------------------------------------------------------------------


def read_csv(spark: SparkSession, path: str, schema: str, separator: str = ",") -> DataFrame:
    return spark.read.schema(schema).option("header", "true").option("sep", separator).option("escape", '"').csv(path)


def csv_upsert(existing: DataFrame, path: str, schema: str, key: str, position: str) -> DataFrame:
    """CSV records merged into a table by primary key."""
    return upsert(existing, read_csv(existing.sparkSession, path, schema), key, position)


def write_csv(df: DataFrame, path: str, fields: list[str], selector: Column | None = None, separator: str = ",") -> None:
    """Chosen columns, and rows if a selector is given, as CSV."""
    rows = df if selector is None else df.where(selector)
    rows.select(*fields).write.option("header", "true").option("sep", separator).option("escape", '"').csv(path)


def store_table(df: DataFrame, path: str, sort: list[str]) -> None:
    """A cleaned table partitioned by source, sorted within files for row-group skipping.

    Rebalancing brings a source's rows together and splits those of a hot one again.
    """
    rows = df.hint("rebalance", F.col("source"), *map(F.col, sort[:1]))
    rows.sortWithinPartitions("source", *sort).write.partitionBy("source").parquet(path)


def store_bucketed(df: DataFrame, table: str, key: str, buckets: int = 64) -> None:
    """A table of the catalog, bucketed and sorted by a key, with Bloom filters of the key.

    Joins and groupings by the key read it without an exchange, with each other too if they have as
    many buckets; a lookup reads the one bucket file, and of it only row groups that may hold
    the key. Rows are dealt out to their buckets before the write, so that each bucket is one file.
    """
    rows = df.repartition(buckets, key)
    rows.write.bucketBy(buckets, key).sortBy(key).option(f"parquet.bloom.filter.enabled#{key}", "true").format("parquet").mode("overwrite").saveAsTable(table)


# -- wiki markup ----------------------------------------------------------------------


def read_wiki_files(spark: SparkSession, path: str) -> DataFrame:
    """Wiki markup files, one page each, titled by their file name."""
    raw = spark.read.text(path, wholetext=True)
    name = F.regexp_extract(F.input_file_name(), r"([^/]+)\.wiki$", 1)
    return raw.select(F.url_decode(name).alias("pageTitle"), F.col("value").alias("wikiMarkup"))


def parse_template(pages: DataFrame, template: str, parameters: list[str], markup: str = "wikiMarkup") -> DataFrame:
    """Parameters of a template on each page as columns; a repeated one counts last.

    Values may hold links and inner templates. Pages without the template are dropped.
    """
    schema = pages.withColumn("_pairs", F.lit(None).cast("array<struct<name:string,value:string>>")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [records.template_parameters(text, template) for text in batch.column(markup).to_pylist()]
            pairs = [None if pair is None else [{"name": n, "value": v} for n, v in pair] for pair in found]
            kind = pa.list_(pa.struct([("name", pa.string()), ("value", pa.string())]))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(pairs, kind)], names=[*batch.schema.names, "_pairs"])

    parsed = pages.mapInArrow(run, schema).where("_pairs IS NOT NULL")

    def value(name: str) -> Column:
        return F.try_element_at(F.filter("_pairs", lambda p: p["name"] == name), F.lit(-1))["value"].alias(name)

    return parsed.select(*pages.columns, *[value(n) for n in parameters])


def render_template(template: str, parameters: dict[str, str]) -> Column:
    """A record as template markup, nulls and technical keys left out."""
    lines = [
        F.when(F.col(column).isNotNull(), F.concat(F.lit(f"|{name}="), F.col(column).cast("string")))
        for name, column in parameters.items()
        if name not in TECHNICAL_KEYS
    ]
    return F.concat_ws("\n", F.lit("{{" + template), *lines, F.lit("}}"))


def export_series(series: DataFrame, events: DataFrame, key: str, parameters: dict[str, str], url: str) -> DataFrame:
    """Series markup and the markup of its events, one row per page.

    Events carry the upper-case series name and the id in their bibliography URL.
    """
    page = series.select(F.col(key), F.lit("series").alias("kind"), F.col(key).alias("pageId"),
                         render_template("Event series", {"Acronym": "acronym", "DblpSeries": key}).alias("markup"))
    dblp_id = F.regexp_replace(F.regexp_replace(F.col(url), "^https://dblp.org/db/conf/", ""), r"\.html", "")
    joined = events.join(series.select(key, F.upper("acronym").alias("_series")), key).withColumn("_dblp", dblp_id)
    markup = render_template("Event", {**parameters, "Series": "_series", "DblpConferenceId": "_dblp"})
    return page.unionByName(joined.select(key, F.lit("event").alias("kind"), F.col("eventId").alias("pageId"), markup.alias("markup")))


# -- triples --------------------------------------------------------------------------

_NODE = r"<[^>]*>|_:\S+"
_TRIPLE = rf'^\s*({_NODE})\s*<([^>]*)>\s*(?:({_NODE})|"((?:[^"\\]|\\.)*)"(?:@([A-Za-z0-9-]+)|\^\^<[^>]*>)?)\s*\.\s*(?:#.*)?$'


def _decoded(text: Column) -> Column:
    """Escapes of a literal, read as those of a JSON string after the two that JSON lacks."""
    codes = F.regexp_extract_all(text, F.lit(r"(?<!\\)(?:\\\\)*\\U([0-9A-Fa-f]{8})"), F.lit(1))
    code = lambda c: F.conv(c, 16, 10).cast("int")
    unit = lambda n: F.concat(F.lit("\\u"), F.lpad(F.hex(n), 4, "0"))
    above = lambda c: code(c) - 0x10000
    pair = lambda c: F.concat(unit(F.floor(above(c) / 1024) + 0xD800), unit(above(c) % 1024 + 0xDC00))
    short = F.aggregate(codes, text, lambda t, c: F.replace(t, F.concat(F.lit("\\U"), c), F.when(code(c) < 0x10000, unit(code(c))).otherwise(pair(c))))
    json = F.regexp_replace(short, r"(?<!\\)((?:\\\\)*)\\'", "$1'")
    whole = F.get(F.from_json(F.concat(F.lit('["'), json, F.lit('"]')), "array<string>", {"allowUnquotedControlChars": "true"}), F.lit(0))
    return F.when(text.contains("\\"), whole).otherwise(text)


def read_triples(spark: SparkSession, path: str) -> DataFrame:
    """N-Triples files as (s, p, o, lang); comments and blank lines are skipped.

    Blank nodes keep their ``_:`` name; escapes are decoded. Any other line is an error.
    """
    lines = spark.read.text(path).where(~F.col("value").rlike(r"^\s*(?:#.*)?$"))
    # one match a line: its groups between separators, which no line holds, as it ends before them
    parts = F.split(F.regexp_replace("value", _TRIPLE + r"\R?", "\n$1\n$2\n$3\n$4\n$5"), "\n", -1).alias("g")
    wrong = F.raise_error(F.concat(F.lit("not a triple: "), F.substring("value", 1, 200))).cast("array<string>")
    lines = lines.select("value", parts).select(F.when(F.size("g") == 6, F.col("g")).otherwise(wrong).alias("g"))

    def group(i: int) -> Column:
        return F.col("g")[i]

    def node(i: int) -> Column:
        return F.when(group(i).startswith("<"), _decoded(F.substring(group(i), F.lit(2), F.length(group(i)) - 2))).otherwise(group(i))

    return lines.select(
        node(1).alias("s"), _decoded(group(2)).alias("p"),
        F.when(group(3) != "", node(3)).otherwise(_decoded(group(4))).alias("o"), F.nullif(group(5), F.lit("")).alias("lang"),
    )


_DIRECTIVE = r"(?i)^(?:\s++|#[^\n]*+\n)*+@?(?:prefix|base)\s"


def read_turtle(spark: SparkSession, path: str) -> DataFrame:
    """Turtle files as (s, p, o, lang): prefixed names, lists, nested blank nodes, collections.

    Files are cut into statements inside their splits, whatever their literals hold; see
    :mod:`eventloom.sources.cutting`. Prefixes and the base hold from their place in a file to
    the next declaration in it. Blank nodes without a label are named by file and place. What is
    not Turtle, or uses a prefix that is not declared, is an error.
    """
    statements = cutting.cut(spark, path, cutting.Statements)
    schema = "file bigint, start bigint, seq int, n int, name string, iri string"
    directives = statements.where(F.col("text").rlike(_DIRECTIVE)).mapInArrow(turtle.find_directives, schema)
    # a file may repeat its directives often; only those that change something are kept
    order = ["start", "seq", "n"]
    base = F.last(F.when(F.col("name").isNull(), F.col("iri")), ignorenulls=True).over(W.partitionBy("file").orderBy(*order))
    given = F.struct("iri", F.when(~F.col("iri").rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), F.col("base")).alias("base"))
    before = F.lag("given").over(W.partitionBy("file", "name").orderBy(*order))
    same = F.col("given").eqNullSafe(F.col("before")) & (F.col("name").isNotNull() | F.col("given.base").isNull())
    changes = directives.withColumn("base", base).withColumn("given", given).withColumn("before", before).where(~same)
    place = F.struct("start", "seq", "n", "name", "iri")
    known = changes.groupBy("file").agg(F.to_json(F.array_sort(F.collect_list(place))).alias("directives"))
    return statements.join(known, "file", "left").mapInArrow(turtle.read_statements, "s string, p string, o string, lang string")


def escaped(text: Column) -> Column:
    """A literal's text with the escapes that a triple line needs."""
    for plain, written in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r")):
        text = F.replace(text, F.lit(plain), F.lit(written))
    return text


def triple_lines(triples: DataFrame, base: str, links: Column, blank: Column | None = None) -> DataFrame:
    """Triples as N-Triples lines; objects are IRIs where ``links`` holds, subjects blank nodes where ``blank`` does."""
    literal = F.concat(F.lit('"'), escaped(F.col("o")), F.lit('"'), F.coalesce(F.concat(F.lit("@"), "lang"), F.lit("")))
    iri = lambda c: F.concat(F.lit(f"<{base}"), c, F.lit(">"))
    subject = iri(F.col("s")) if blank is None else F.when(blank, F.concat(F.lit("_:b"), "s")).otherwise(iri(F.col("s")))
    return triples.select(
        F.concat(subject, F.lit(" "), iri(F.col("p")), F.lit(" "), F.when(links, iri(F.col("o"))).otherwise(literal), F.lit(" .")).alias("value")
    )
