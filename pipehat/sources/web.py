"""Requests in the shapes of a web tool: JSON over an engine, without sockets; and the texts they are made of."""

from __future__ import annotations

import json
from urllib.parse import unquote_plus

from pyspark.sql import Column
from pyspark.sql import functions as F

from pipehat.functions import hl7
from pipehat.operators.engine import Engine
from pipehat.operators.queues import QueueProblem

HEALTH = {"status": "healthy", "version": "1.0.0", "features": ["persistence", "indexing"]}
SAMPLES = {
    "ADT^A01 (Patient Admission)": ["MSH|^~\\&|WARD|CLINIC|HUB|CENTRAL|20240102030405||ADT^A01|S1|P|2.5", "EVN|A01|20240102030405", "PID|1||1001^^^MRN||BROWN^ANNA||19700101|F", "PV1|1|I|3^12^1"],
    "ORU^R01 (Lab Result)": ["MSH|^~\\&|LAB|CLINIC|HUB|CENTRAL|20240102040506||ORU^R01|S2|P|2.5", "PID|1||1002^^^MRN||GREEN^PAUL||19810203|M", "OBR|1|O1|L1|GLU^GLUCOSE", "OBX|1|NM|GLU^Glucose||5.1|mmol/L"],
    "ORM^O01 (Order)": ["MSH|^~\\&|DESK|CLINIC|HUB|CENTRAL|20240102050607||ORM^O01|S3|P|2.5", "PID|1||1003^^^MRN||WHITE^MARY||19920304|F", "ORC|NW|O2", "OBR|1|O2||CT^CT SCAN"],
}


def json_text(x: Column) -> Column:
    """A text as JSON, quoted; null for NULL."""
    return F.coalesce(F.regexp_extract(F.to_json(F.array(x)), r"(?s)^\[(.*)\]$", 1), F.lit("null"))


def url_text(x: Column) -> Column:
    """The text that a percent-encoded one stands for; + is a space."""
    return F.url_decode(x)


class Web:
    """Answers (status, body) to (method, path with its query, body). At most max_rows rows of a result are given."""

    def __init__(self, engine: Engine, max_rows: int = 10_000):
        self.engine, self.max_rows = engine, max_rows

    def handle(self, method: str, path: str, body: str = "") -> tuple[int, str]:
        path, _, asked = path.partition("?")
        store = self.engine.store
        if path == "/api/health":
            return self._json(HEALTH)
        if path == "/api/samples":
            return self._json({"samples": [{"name": k, "message": "\r".join(v) + "\r"} for k, v in SAMPLES.items()]})
        if path == "/api/queues":
            return self._json({"queues": [{"name": r.queue, "messages": r.messages, "history": r.history} for r in store.statistics().orderBy("queue").collect()]})
        if path == "/api/statistics":
            rows = store.statistics().collect()
            active, past = sum(r.messages for r in rows), sum(r.history for r in rows)
            return self._json({"total_queues": len(rows), "total_messages": active, "total_history": past, "grand_total": active + past})
        if path == "/api/query":
            _, found, text = (body if method == "POST" else asked).partition("query=")
            return self.query(unquote_plus(text)) if found else self._error("Missing query parameter")
        if path == "/api/insert" and method == "POST":
            return self.insert(body)
        return 404, "Not Found"

    def query(self, text: str) -> tuple[int, str]:
        out = self.engine.run(text)
        if out.has_error():
            return self._json({"success": False, "error": out.message or "Unknown error"})
        rows = out.rows(self.max_rows)
        return self._json({"success": True, "rows_affected": out.affected, "num_rows": len(rows), "rows": [dict(zip(out.columns, r, strict=True)) for r in rows]})

    def insert(self, body: str) -> tuple[int, str]:
        """The message of a JSON body {"queue", "message"}."""
        try:
            asked = json.loads(body)
        except ValueError:
            return self._error("Missing request body")
        for key in ("queue", "message"):
            if not isinstance(asked, dict) or not isinstance(asked.get(key), str):
                return self._error(f"Missing {key} parameter")
        frame = self.engine.store.spark.createDataFrame([(asked["message"],)], "raw_message string")
        if not frame.select(hl7.is_message(F.col("raw_message"))).first()[0]:
            return self._error("Invalid HL7 message")
        try:
            self.engine.store.insert(asked["queue"], asked["message"])
        except QueueProblem:
            return self._error("Queue not found")
        return self._json({"success": True, "message": "Message inserted successfully"})

    @staticmethod
    def _json(x) -> tuple[int, str]:
        return 200, json.dumps(x, separators=(",", ":"), ensure_ascii=False)

    @staticmethod
    def _error(text: str) -> tuple[int, str]:
        return 400, json.dumps({"error": text}, separators=(",", ":"))
