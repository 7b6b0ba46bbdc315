"""Tables as corpus: frames of ``(path, content)``, and the corpus derived from documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rivulint.session import CORPUS_PARTITIONS

# The code put around every document's whole text to make it a source file.
SNIPPETS = [
    (".py", "import os\nx = eval(data)\nos.system(user_cmd)  # TODO later\nDEBUG = True\n"
            "try:\n    pass\nexcept:\n    print(\"x\")"),
    (".py", "SECRET_KEY = \"abc\"\ncfg = yaml.load(fh)\nobj = pickle.loads(request.body)\n"
            "subprocess.Popen(cmd, shell=True)\nname = input()\ndef f(a):\n    assert a\n"
            "exec(code)\nreturn HttpResponse('a' + request.GET['q'])\nrows = Item.objects.raw(q)"),
    (".py", "value = ast.literal_eval(text)\nlog.info(\"retrieval (ok)\")"),
    (".js", "document.write(x);\nnode.innerHTML = \"<b>\" + user;\n"
            "localStorage.setItem(\"k\", v);\nconsole.log(v);\neval(s);"),
    (".java", "class A { void m() { try { go(); } catch (Exception e) { } }\n"
              "Runtime.getRuntime().exec(cmd);\n"
              "stmt.executeQuery(\"SELECT a FROM t WHERE id=\" + id);\n"
              "Statement s = \"x\" + y;\nSystem.out.println(s);\n"
              "stmt.executeUpdate(\"DELETE FROM t WHERE id=\" + id);"),
    (".c", "gets(buf);\nstrcpy(a, b);\nsprintf(a, \"%d\", n);\nscanf(\"%s\", a);\n"
           "char *p = malloc(10);\nfree(p);\nsystem(\"ls\");\nfgets(buf, 9, f);"),
    (".html", "<body onload=\"go()\">\n<a href=\"javascript:go()\">x</a>\n"
              "<script src=\"a.js\"></script>\n<!-- TODO fix -->\n</html>\n"
              "<script type=\"x\"> <!-- old\n<p onclick=\"javascript:go()\">"),
    (".css", "a { width: expression(1); color: red !important; }"),
    (".php", "<?php\n$r = $db->query(\"SELECT * FROM t WHERE id=$_GET[id]\");\n"
             "echo $_GET['q'];\necho htmlspecialchars($_GET['q']);\n"
             "system('ls ' . $_POST['d']);\ninclude($_GET['page']);\n"
             "header('Location: ' . $next);\n// go\n\nexit;"),
    (".php", "<?php\nfunction load() { return @fopen($p, 'r'); }\n"
             "function __construct() {}\n$password = 'changeme';\n$secret = 's3cr3t-v';\n"
             "$h = md5($password);\nif ($row['password'] == $x) { var_dump($row); }\n"
             "$token = uniqid();\nmysql_query($q);\nheader('Location: /a');\necho 1;"),
    (".php", "<form action='a' method='post'>\n<?= $_GET['z'] ?>\n"
             "<?php function load() {} move_uploaded_file($a, $b);\n"
             "extract($_POST); $o = unserialize($_COOKIE['c']);\n"
             "fopen('../' . $_GET['f'], 'r');"),
    (".php", "<form method=\"post\"><input name=\"csrf\"></form>\n"
             "<?php $ext = pathinfo($n); move_uploaded_file($a, $b); error_reporting(0);"),
    (".php", "<?php\ndefine('ENCRYPTION_KEY', 'abcd1234');\n"
             "header(\"Location: $_GET[u]\");\nexit;\n"
             "$q = \"SELECT a FROM t WHERE id=$id\";\n$list = split(',', $s);\n"
             "$w = 'SELECT a FROM t WHERE id=' . $_POST['id'];\neval($code);\nexec($line);\n"
             "$r = $_POST['id'] . query($q);"),
]
# What every web page ends with, so that pages have something to report.
PAGE_SNIPPET = "\n<body onload=\"go()\">\n<script src=\"a.js\"></script> <!-- TODO -->\n"
# Where the files lie: plain folders and folders the profiles prune.
FOLDERS = ["src", "src", "app/core", "lib", "web/static", "src", "vendor/pkg", "dist",
           "node_modules/m", "uploads"]
# Tasks for each core where a corpus is dealt out for long work.
TASKS_A_CORE = 4


def table_corpus(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """A stored table of (path, content) and optional read_error as corpus."""
    df = spark.read.format(fmt).load(path)
    if "read_error" not in df.columns:
        df = df.withColumn("read_error", F.lit(None).cast("string"))
    return df.select("path", "content", "read_error")


def _pick(options: list[str], number: Column) -> Column:
    values = F.array(*[F.lit(o) for o in options])
    return values.getItem((number % len(options)).cast("int"))


def documents_as_code(documents: DataFrame, *keep: str) -> DataFrame:
    """Every document, with its whole text, as one source file; one without a text has no
    content."""
    doc = F.col("doc_id")
    number = doc.cast("string")
    snippet = _pick([s for _, s in SNIPPETS], doc)
    return documents.select(
        F.concat(
            F.lit("repo"), (doc % 7).cast("string"), F.lit("/"), _pick(FOLDERS, doc),
            F.lit("/f"), number, _pick([e for e, _ in SNIPPETS], doc),
        ).alias("path"),
        F.concat(
            snippet, F.lit("\n"), F.col("text"), F.lit("\n"), snippet, F.lit("\n"),
        ).alias("content"),
        *keep,
    )


def code_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    partitions = spark.conf.get(CORPUS_PARTITIONS, None)
    if partitions:
        documents = documents.repartition(int(partitions), "doc_id")
    return documents_as_code(documents)


def spread_code_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``code_files`` for work that is long for each file.

    A table read in few tasks, or in tasks unlike in work, would leave cores idle; its documents
    are dealt over several tasks a core.  One read in as many tasks stays where it is.
    """
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    tasks = TASKS_A_CORE * spark.sparkContext.defaultParallelism
    if spark.conf.get(CORPUS_PARTITIONS, None) or documents.rdd.getNumPartitions() >= tasks:
        return code_files(spark, sf_dir)
    return documents_as_code(documents.repartition(tasks, "doc_id"))


def page_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Web pages as HTML files."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("url", "html")
    return pages.select(
        F.concat("url", F.lit(".html")).alias("path"),
        F.concat("html", F.lit(PAGE_SNIPPET)).alias("content"),
    )


def reported_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The corpus with read errors: documents of two sources count as unreadable files."""
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet").select(
        "doc_id", "text", "source"
    )
    return with_read_errors(documents_as_code(documents, "source"))


def with_read_errors(files: DataFrame) -> DataFrame:
    """Files with the source of their documents; two sources, but none that is missing, are
    unreadable."""
    unreadable = F.coalesce(F.col("source").isin("src3", "src7"), F.lit(False))
    return files.select(
        "path",
        F.when(~unreadable, F.col("content")).alias("content"),
        F.when(unreadable, F.concat(F.lit("Permission denied in "), "source")).alias(
            "read_error"
        ),
    )
