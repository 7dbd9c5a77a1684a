"""The ``.env`` file, the document parser and the language model over HTTP, unreadable files, the report as text."""

import http.server
import json
import os
import threading

import pytest
from pyspark.sql import functions as F

from litloom.operators import library
from litloom.sources import clients, dotenv, files


@pytest.mark.parametrize(
    "text,want",
    [
        ("A=1\nB=two words", {"A": "1", "B": "two words"}), ("# c\n\n  \nA=1\n  # d\nB=2", {"A": "1", "B": "2"}), ("A=\"x y\"\nB='z'", {"A": "x y", "B": "z"}),
        ('D="l1\\nl2"\nS=\'l1\\nl2\'', {"D": "l1\nl2", "S": "l1\\nl2"}), ("U=jdbc:x?a=b&c=d\nK=YWJj==", {"U": "jdbc:x?a=b&c=d", "K": "YWJj=="}), ("P=p@ss#word!", {"P": "p@ss#word!"}),
        ("export K=sk-abc", {"K": "sk-abc"}), ("K=\nM=x", {"K": "", "M": "x"}), ("no equals\n=x\nA=1\nB=2", {"A": "1", "B": "2"}), ("", {}), ("# only\n", {}), ("A=first\nA=second", {"A": "second"}),
        ('Q="a\\"b\\\\c\\td\\re"', {"Q": 'a"b\\c\td\re'}), ("A = spaced ", {"A": "spaced"}), ("H='half", {"H": "'half"}),
    ],
)
def test_dotenv_lines(tmp_path, text, want):
    (tmp_path / ".env").write_text(text, encoding="utf-8")
    assert dotenv.parse(tmp_path / ".env") == want


def test_dotenv_precedence_and_search(tmp_path):
    deep = tmp_path / "a" / "b" / "c" / "d" / "e"
    deep.mkdir(parents=True)
    (tmp_path / "a" / ".env").write_text("M=file\nU=file\n")
    assert dotenv.parse(tmp_path / "nope.env") == {} and dotenv.locate(deep, {}) == tmp_path / "a" / ".env" and dotenv.locate(deep / "f", {}) is None
    (tmp_path / "other.env").write_text("M=other\n")
    named = {"DOTENV_PATH": str(tmp_path / "other.env")}
    assert dotenv.locate(deep, named) == tmp_path / "other.env" and dotenv.locate(deep, {"DOTENV_PATH": str(tmp_path / "gone")}) == tmp_path / "a" / ".env"
    assert dotenv.settings(deep, {"M": "real"}, {"U": "default", "X": "default"}) == {"M": "real", "U": "file", "X": "default"}
    assert dotenv.settings(tmp_path / "a" / "b", named) == {"M": "other"}


class _Service(http.server.BaseHTTPRequestHandler):
    seen: list = []
    fail = 0

    def do_GET(self):
        self._answer(b"true")

    def do_POST(self):
        body = self.rfile.read(int(self.headers["Content-Length"]))
        type(self).seen.append((self.path, self.headers["Content-Type"], body))
        if type(self).fail:
            type(self).fail -= 1
            self.send_error(503)
            return
        if self.path.endswith("/chat/completions"):
            asked = json.loads(body)
            told = f"{asked['temperature']}|{asked['messages'][1]['content']}"
            self._answer(json.dumps({"choices": [{"message": {"content": told}}], "usage": {"prompt_tokens": 5, "completion_tokens": 3}}).encode())
        else:
            self._answer(b"" if b"empty" in body else b"<TEI/>")

    def _answer(self, body):
        self.send_response(200)
        self.send_header("Content-Length", str(len(body)))
        self.end_headers()
        self.wfile.write(body)

    def log_message(self, *args):
        pass


@pytest.fixture
def service():
    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), _Service)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    _Service.seen, _Service.fail = [], 0
    yield f"http://127.0.0.1:{server.server_port}"
    server.shutdown()
    server.server_close()


def test_document_parser(service):
    parser = clients.DocumentParser(service, pause=0.0, segment_sentences=True)
    assert parser.alive() and not clients.DocumentParser("http://127.0.0.1:9").alive()
    _Service.fail = 2
    assert parser(b"%PDF") == "<TEI/>" and len(_Service.seen) == 3
    path, kind, body = _Service.seen[-1]
    assert path == "/api/processFulltextDocument" and kind.startswith("multipart/form-data") and b'name="teiCoordinates"\r\n\r\np' in body and b"%PDF" in body and b'name="segmentSentences"\r\n\r\n1' in body
    _Service.fail, _Service.seen = 3, []
    with pytest.raises(OSError):
        parser(b"%PDF")
    assert len(_Service.seen) == 3
    _Service.seen = []
    with pytest.raises(ValueError):
        parser(b"empty")
    assert len(_Service.seen) == 1


def test_chat_model_with_policies(spark, service):
    chat = clients.ChatModel(service, "m", "secret")
    assert chat("hello", clients.SYNTHESIS_POLICY) == clients.Answer("0.3|hello", 5, 3)
    bound = clients.under(clients.EXTRACTION_POLICY, chat)
    assert bound("hi").text == "0.0|hi" and clients.under(clients.EXTRACTION_POLICY, len) is len
    sent = json.loads(_Service.seen[-1][2])
    assert sent["messages"][0] == {"role": "system", "content": clients.EXTRACTION_POLICY.system} and sent["max_tokens"] == 4096
    rows = clients.call_rows(spark.createDataFrame([(1, "x")], "id long, prompt string"), "id", "prompt", bound).collect()
    assert tuple(rows[0]) == (1, "0.0|x", None, 5, 3)


def test_unreadable_files_and_report(spark, tmp_path):
    (tmp_path / "ok.pdf").write_bytes(b"x")
    rows = spark.createDataFrame(
        [(1, "a", "Title a", "ok.pdf", f"file:{tmp_path}/ok.pdf", "A", 2001, "v", "d1"), (2, "b", "Title b", "no.pdf", f"file:{tmp_path}/no.pdf", "B", None, "v", "d2"), (3, "c", "Title a", "z.pdf", None, "C", 2003, None, "d1"), (4, None, " ", None, None, None, None, None, None)],
        "pos int, citekey string, title string, declared_file string, pdf_path string, authors string, year int, venue string, doi string",
    ).withColumn("readable", files.readable(F.col("pdf_path")))
    report = library.report(rows, "pos", F.col("readable"))
    got = {r.pos: list(r.problems) for r in report.collect()}
    assert got[1] == [] and got[2] == [f"PDF is not readable: file:{tmp_path}/no.pdf"] and got[3] == ["attachment not found: z.pdf", "duplicate of a"]
    lines = [r.line for r in library.report_lines(report, "pos", spark.createDataFrame([("d/left over.pdf",)], "path string")).collect()]
    assert lines == [
        "BibTeX library: 1 ingestable / 4 total", "  rejected (3):", f"    - b: PDF is not readable: file:{tmp_path}/no.pdf", "    - c: attachment not found: z.pdf, duplicate of a",
        "    - ?: missing citekey, missing title, no attachment declared", "  duplicates (1):", "    - c duplicates a", "  PDFs on disk with no bib entry (1):", "    - left over.pdf",
    ]
    assert [tuple(r) for r in files.read_bytes(spark, str(tmp_path), only=rows.where("pos = 1").withColumnRenamed("pdf_path", "path")).select("path", F.length("content")).collect()] == [(f"file:{tmp_path}/ok.pdf", 1)]
    assert os.path.exists(tmp_path / "ok.pdf")
