"""CSV files of one folder whose headers differ: listed, grouped by header, and read group by group."""

from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession

from ..operators.frame import stack

#: Files whose headers the driver reads at a time; one line of each is read.
AT_ONCE = 16


def _hidden(name: str) -> bool:
    return name.startswith((".", "_")) and "=" not in name


def list_files(spark: SparkSession, path: str) -> tuple[str, list[str]]:
    """(folder, files): every non-empty file below `path`, a file, a folder with any folders inside, or a pattern; as for any
    Spark reader, names that begin with a dot or an underscore are left out. An error if there is none."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    root = jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(conf)
    found = fs.globStatus(root)
    files = []
    for status in found or []:
        top = status.getPath()
        if status.isFile():
            files.append((top.toString(), status.getLen()))
            continue
        under = fs.listFiles(top, True)
        skip = len(top.toString()) + 1
        while under.hasNext():
            file = under.next()
            name = file.getPath().toString()
            if not any(map(_hidden, name[skip:].split("/"))):
                files.append((name, file.getLen()))
    if not files:
        raise FileNotFoundError(f"no files at {path}")
    # Folders named key=value below this one become columns.
    folder = found[0].getPath() if len(found) == 1 and found[0].isDirectory() else None
    while folder is None or any(c in folder.toString() for c in "*?{["):
        folder = (folder or root).getParent()
    return folder.toString(), sorted(name for name, size in files if size)


def first_line(spark: SparkSession, file: str) -> str:
    """The first line of a text file, compressed or not."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    place = jvm.org.apache.hadoop.fs.Path(file)
    stream = place.getFileSystem(conf).open(place)
    try:
        codec = jvm.org.apache.hadoop.io.compress.CompressionCodecFactory(conf).getCodec(place)
        plain = stream if codec is None else codec.createInputStream(stream)
        return (jvm.java.io.BufferedReader(jvm.java.io.InputStreamReader(plain, "UTF-8")).readLine() or "").rstrip("\r")
    finally:
        stream.close()


def by_header(spark: SparkSession, path: str) -> tuple[str, dict[str, list[str]]]:
    """(folder, {header: files}) of the files at `path`."""
    folder, files = list_files(spark, path)
    groups = {}
    with ThreadPoolExecutor(AT_ONCE) as pool:
        for file, header in zip(files, pool.map(lambda f: first_line(spark, f), files), strict=True):
            groups.setdefault(header, []).append(file)
    return folder, groups


def read_by_header(spark: SparkSession, path: str, options: dict, required=()) -> DataFrame:
    """All rows of the CSV files at `path` as text, matched by column name whatever the order of columns in each file.

    Spark takes one file's header for all files of a scan, so there is one scan for each different header; a column that
    a file lacks is NULL in its rows. An error names a file without one of the `required` columns.
    """
    folder, groups = by_header(spark, path)
    tables = []
    for files in groups.values():
        table = spark.read.options(**options).option("basePath", folder).csv(files)
        absent = sorted(set(required) - set(table.columns))
        if absent:
            raise ValueError(f"{files[0]} lacks the columns {', '.join(absent)}")
        tables.append(table)
    return stack(*tables) if tables else spark.createDataFrame([], ", ".join(f"`{c}` string" for c in required) or "_c0 string")
