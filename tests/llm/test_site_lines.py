from collections import defaultdict
from pathlib import Path

from pyspark.sql import functions as F

from inkwell.llm import site_lines
from inkwell.sources.tables import page_rows


def pages(spark, n, site="http://s.example/", step=1):
    rows = [(i, f"{site}{i}", 1, i * step) for i in range(n)]
    return page_rows(spark.createDataFrame(rows, "doc_id bigint, url string, word_number int, fetched_at int"))


def lines(spark, data):
    return spark.createDataFrame(data, "doc_id bigint, line_no int, line string")


def test_repeats_within_a_site(spark, rows):
    data = [(i, 1, f" Copyright  {2000 + i}\tX ") for i in range(6)] + [(i, 2, f"only {'abcdef'[i]}") for i in range(6)]
    data += [(i, 3, None) for i in range(6)] + [(i, 4, " \t ") for i in range(6)] + data[:6]
    got = rows(site_lines.repeated_lines(lines(spark, data), pages(spark, 6)))
    assert got == [(i, 1) for i in range(6)]
    assert rows(site_lines.repeated_lines(lines(spark, data), pages(spark, 6), 7)) == []


def test_lines_of_one_page_count_once_and_no_site_counts_not(spark, rows):
    data = [(0, n, "same") for n in range(1, 9)]
    assert rows(site_lines.repeated_lines(lines(spark, data), pages(spark, 1), 2)) == []
    p = page_rows(spark.createDataFrame([(i, None, 1, i) for i in range(9)], "doc_id bigint, url string, word_number int, fetched_at int"))
    assert rows(site_lines.repeated_lines(lines(spark, [(i, 1, "same") for i in range(9)]), p)) == []


def test_partitions_make_no_difference(spark, rows):
    # the threshold is crossed by the later half only, so earlier pages must be rebuilt
    data = [(i, 1, "menu") for i in range(5)]
    for step in (0, 1, -1):
        assert rows(site_lines.repeated_lines(lines(spark, data), pages(spark, 5, step=step))) == [(i, 1) for i in range(5)]


def three_runs(spark, path, sites):
    """Pages 0 … 8 of two sites in three runs; before the last, all files of the second site's bucket are broken."""
    p = page_rows(spark.createDataFrame([(i, f"http://{sites[i // 9]}/{i}", 1, i) for i in range(18)], "doc_id bigint, url string, word_number int, fetched_at int"))
    placed = site_lines.bucketed(p)
    data = lines(spark, [(i, 1, "menu") for i in range(18)] + [(i, 2, f"own {'abcdefghi'[i % 9]}") for i in range(18)] + [(i, 3, "late") for i in (0, 6, 7, 8)])
    keyed = site_lines.keyed_lines(data, placed)
    texts = data.join(placed.select("doc_id", "bucket"), "doc_id")
    for where in ("doc_id IN (0, 1, 2, 3) OR doc_id > 8", "doc_id IN (4, 5)", "doc_id IN (6, 7, 8)"):
        store = site_lines.SiteLines(spark, path, 4 if "1" in where else store.min_pages)
        if "6" in where:
            other = placed.where("doc_id = 9").first().bucket
            for f in Path(path).glob(f"*/version=*/bucket={other}/*.parquet"):
                f.write_text("broken")
            for f in Path(path).glob(f"*/version=*/bucket={other}/.*.crc"):
                f.unlink()
        yield store.add(keyed.where(where), texts.where(where)), site_lines.SiteLines(spark, path, 4)


def test_three_runs_of_a_kept_table(spark, rows, tmp_path):
    # sites of different buckets
    name = spark.range(100).selectExpr("concat('s', id, '.example') AS site").selectExpr("site", f"pmod(xxhash64(site), {site_lines.BUCKETS}) AS b").collect()
    sites = [name[0].site, next(r.site for r in name if r.b != name[0].b)]
    own = lambda ids: [(i, 2, f"own {'abcdefghi'[i % 9]}") for i in ids]
    runs = three_runs(spark, str(tmp_path / "kept"), sites)
    update, store = next(runs)
    assert update.version == 1 and len(update.touched) == 2 and store.version == 1
    assert rows(store.repeated()) == sorted([(i, 1) for i in (0, 1, 2, 3, *range(9, 18))], key=repr)
    assert rows(store.clean(), "doc_id", "line_no", "line") == sorted(own([0, 1, 2, 3, *range(9, 18)]) + [(0, 3, "late")], key=repr)
    update, store = next(runs)
    assert update.crossing == [] and len(update.touched) == 1 and store.version == 2
    update, store = next(runs)  # the third run crosses the threshold for "late", and rewrites page 0 only; the other site isn't read
    assert len(update.crossing) == 1
    where = store._read("rebuilt", [3]).collect()
    assert [r.doc_id for r in where] == [0]
    assert rows(store._read("clean", [3]), "doc_id", "line_no") == [(0, 2), (6, 2), (7, 2), (8, 2)]


def test_clean_lines_of_pages_without_a_site(spark, rows):
    data = [(i, 1, "menu") for i in range(6)] + [(i, 2, f"own {'abcdef'[i]}") for i in range(6)] + [(9, 1, "menu"), (9, 2, None), (0, 2, None)]
    got = rows(site_lines.clean_lines(lines(spark, data), pages(spark, 6)))
    assert got == sorted([(i, 2, f"own {'abcdef'[i]}") for i in range(6)] + [(9, 1, "menu"), (9, 2, None)], key=repr)


def test_hot_site_against_brute_force(spark, rows):
    data = [(i, k, f"line {'xyz'[(i * k) % 3]} {'ab' * ((i + k) % 4)}") for i in range(40) for k in range(1, 6)]
    seen = defaultdict(set)
    for d, _, t in data:
        seen[t].add(d)
    want = sorted((d, k) for d, k, t in data if len(seen[t]) >= 5)
    got = site_lines.repeated_lines(lines(spark, data).withColumn("site", F.lit("clash")), pages(spark, 40))
    assert rows(got) == sorted(want, key=repr)


def test_empty(spark, rows):
    assert rows(site_lines.repeated_lines(lines(spark, []), pages(spark, 2))) == []
    assert rows(site_lines.repeated_lines(lines(spark, [(1, 1, "x")]), pages(spark, 0))) == []
