"""Queries of sources: scanned pages, watched folders, bundles and books."""

from __future__ import annotations

import uuid
from itertools import islice

from pyspark.sql import functions as F

from ..functions import block_font
from ..operators import library as L
from ..session import shared_folder, ship, table
from ..sources import bundles
from ..streaming import watch
from .queries_text import _HTML, _TRIM
from .registry import query


#: Images of a batch, of 26 or 52 kB each.
IMAGES = 128


def scan_images(docs):
    """(path, page_no, image): every text on drawn pages; two full pages share an image, and images are turned in all four directions."""

    def run(batches):
        import pandas as pd

        from lectern.functions import block_font

        drawn = ((str(key), n, image) for b in batches for key, text in zip(b["doc_id"], b["text"]) for n, image in enumerate(block_font.images(text or "", int(key))))
        while out := list(islice(drawn, IMAGES)):
            yield pd.DataFrame(out, columns=["path", "page_no", "image"]).astype({"page_no": "int32"})

    return docs.select("doc_id", "text").mapInPandas(run, "path string, page_no int, image binary")


def _cleaned(x: str) -> str:
    return _TRIM.format(f"regexp_replace({x}, '[ \\t]+\\n|\\n{{3,}}', chr(10) || chr(10), 'g')")


@query("oriented_scans", f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
i AS (SELECT doc_id, t, unnest(range(0, greatest(1, length(t) // 3000 + (length(t) % 3000 + 1499) // 1500))) AS page_no, length(t) // 3000 AS pairs FROM d),
p AS (SELECT doc_id, page_no, CASE WHEN page_no < pairs THEN substr(t, 3000 * page_no + 1, 1500) ELSE substr(t, 3000 * pairs + 1500 * (page_no - pairs) + 1, 1500) END AS l,
        CASE WHEN page_no < pairs THEN substr(t, 3000 * page_no + 1501, 1500) ELSE '' END AS r FROM i),
c AS (SELECT doc_id, page_no, {_cleaned('l')} AS l, {_cleaned('r')} AS r FROM p)
SELECT doc_id, page_no::INT AS page_no, (l <> '')::INT + (r <> '')::INT AS passes,
  sha256(CASE WHEN l = '' THEN r WHEN r = '' THEN l ELSE l || chr(10) || chr(10) || r END) AS text_sha FROM c""")
def oriented_scans(spark, sf_dir):
    """Drawn pages of all documents, turned and doubled, come back as they were."""
    from ..sources.scans import oriented

    ship(spark)
    found = oriented(scan_images(table(spark, sf_dir, "documents")), block_font.read, arrays=True)
    return found.select(F.col("path").cast("long").alias("doc_id"), "page_no", "passes", F.sha2("text", 256).alias("text_sha"))


@query("watch_stream", """WITH e AS (SELECT user_id::VARCHAR AS path, datediff('day', DATE '2024-01-01', ts::DATE) + 1 AS scan, least(count(*), 2) AS size FROM events GROUP BY ALL),
s AS (SELECT *, scan // 5 AS mtime, coalesce(lag(scan) OVER w = scan - 1, false) AS follows FROM e WINDOW w AS (PARTITION BY path ORDER BY scan)),
t AS (SELECT *, follows AND lag(size) OVER w = size AND lag(mtime) OVER w = mtime AS ready, sum(CASE WHEN follows THEN 0 ELSE 1 END) OVER w AS stay
      FROM s WINDOW w AS (PARTITION BY path ORDER BY scan)),
r AS (SELECT *, lag(size) OVER v AS old_size, lag(mtime) OVER v AS old_mtime FROM t WHERE ready WINDOW v AS (PARTITION BY path, stay ORDER BY scan))
SELECT path, size::BIGINT AS size, mtime::BIGINT AS mtime, scan::BIGINT AS scan FROM r WHERE old_size IS NULL OR old_size <> size OR old_mtime <> mtime""")
def watch_stream(spark, sf_dir):
    """Events as scans (a user is a file, a day a scan, the day's events its size): a stream that is stopped twice and goes on from its checkpoint."""
    scan = F.datediff("ts", F.lit("2024-01-01")).cast("long") + 1
    e = table(spark, sf_dir, "events").groupBy(F.col("user_id").cast("string").alias("path"), scan.alias("scan")).agg(F.least(F.count("*"), F.lit(2)).alias("size"))
    stamps = e.select("path", "size", F.floor(F.col("scan") / 5).cast("long").alias("mtime"), "scan", (F.col("scan") - 1).alias("before"))
    base = f"{shared_folder(spark)}/watch-{uuid.uuid4().hex}"

    def keep(batch, epoch):
        batch.write.mode("overwrite").parquet(f"{base}/out/epoch={epoch}")

    for first in (1, 11, 21):
        last = 10**9 if first == 21 else first + 9
        stamps.where(F.col("scan").between(first, last)).write.mode("append").parquet(f"{base}/in")
        stream = spark.readStream.schema(stamps.schema).parquet(f"{base}/in")
        with watch.state_store(spark):
            q = watch.settled(stream, interval=86_400).writeStream.foreachBatch(keep).option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start()
            q.awaitTermination()
    return spark.read.parquet(f"{base}/out").select("path", "size", "mtime", "scan")


@query("bundle_round_trip", f"""{L.SQL}, p AS (SELECT id, kind, category, text, (id % 50) || '.txt' AS base FROM docs),
f AS (SELECT base, min(id) AS first FROM p GROUP BY base),
c AS (SELECT doc_id, source AS name FROM documents UNION ALL SELECT doc_id, 'lang ' || lang FROM documents)
SELECT p.id, CASE WHEN p.id = first THEN base ELSE p.id || '-' || base END AS entry, kind, category, sha256(text) AS sha, string_agg(c.name, ',' ORDER BY c.name) AS collections
FROM p JOIN f USING (base) JOIN c ON c.doc_id = p.id GROUP BY ALL""")
def bundle_round_trip(spark, sf_dir):
    """All documents, each in two collections and many with one file name, written as a bundle of zips and read again."""
    path = F.concat(F.lit("/lib/"), "category", F.lit("/"), (F.col("id") % 50).cast("string"), F.lit(".txt"))
    docs = L.documents(spark, sf_dir).withColumn("path", F.concat(F.lit("/"), F.col("id").cast("string"), path))
    raw = table(spark, sf_dir, "documents")
    names = raw.select(F.col("source").alias("name")).union(raw.select(F.concat(F.lit("lang "), "lang"))).distinct().select(F.xxhash64("name").alias("id"), "name")
    members = raw.select(F.xxhash64("source").alias("collection_id"), "doc_id").union(raw.select(F.xxhash64(F.concat(F.lit("lang "), "lang")), "doc_id"))
    files = docs.select("path", F.col("text").cast("binary").alias("content"))
    at = f"{shared_folder(spark)}/bundle-{uuid.uuid4().hex}"
    bundles.write(bundles.bundled(names, members, docs, L.tags(spark, sf_dir), files), at)
    back = bundles.read(spark, at)
    held = bundles.memberships_of(back).groupBy("entry").agg(F.array_join(F.array_sort(F.collect_list("name")), ",").alias("collections"))
    d = bundles.documents_of(back).join(back.select("entry", F.sha2("content", 256).alias("sha")), "entry").join(held, "entry")
    return d.select("id", "entry", "kind", "category", "sha", "collections")


def _epub_files(pages):
    """(path, content): ten pages a file, the last one first in the spine."""

    def made(rows):
        import io
        import zipfile

        import pandas as pd

        rows, out = rows.sort_values("page_id", ascending=False), io.BytesIO()
        names = [f"text/page {i}.xhtml" for i in rows["page_id"]]
        with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
            z.writestr("META-INF/container.xml", '<container xmlns="urn:oasis:names:tc:opendocument:xmlns:container"><rootfiles><rootfile full-path="OEBPS/book.opf"/></rootfiles></container>')
            items = "".join(f'<item id="p{k}" href="{n.replace(" ", "%20")}"/>' for k, n in sorted(enumerate(names), key=lambda x: x[1]))
            spine = "".join(f'<itemref idref="p{k}"/>' for k in range(len(names)))
            z.writestr("OEBPS/book.opf", f'<package xmlns="http://www.idpf.org/2007/opf"><manifest>{items}</manifest><spine>{spine}</spine></package>')
            for name, html in zip(names, rows["html"]):
                z.writestr(f"OEBPS/{name}", html)
        return pd.DataFrame({"path": [f"/books/{rows['page_id'].iloc[0] // 10}.epub"], "content": [out.getvalue()]})

    return pages.select("page_id", "html").groupBy(F.floor(F.col("page_id") / 10)).applyInPandas(made, "path string, content binary")


@query("epub_pages", f"""SELECT '/books/' || (page_id // 10) || '.epub' AS path, (row_number() OVER (PARTITION BY page_id // 10 ORDER BY page_id DESC) - 1)::INT AS seq,
  sha256({_cleaned(_HTML)}) AS text_sha FROM pages""")
def epub_pages(spark, sf_dir):
    """All pages bound as books and read again, in the order of their spines."""
    from ..sources.epub import epub_pages

    ship(spark)
    return epub_pages(_epub_files(table(spark, sf_dir, "pages"))).select("path", "seq", F.sha2("text", 256).alias("text_sha"))
