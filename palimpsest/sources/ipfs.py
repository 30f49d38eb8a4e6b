"""Blobs in a content-addressed network store, spoken to over its HTTP interface.

Only the standard library is used; executors fetch with ``frame`` in Arrow
batches, so bytes don't pass through the driver.
"""

from __future__ import annotations

import json
import urllib.error
import urllib.request
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame


class IpfsStore:
    def __init__(self, api: str, gateway: str, timeout: float = 30.0):
        self.api, self.gateway, self.timeout = api.rstrip("/"), gateway.rstrip("/"), timeout

    def _post(self, path: str, body: bytes = b"", **headers: str) -> dict:
        request = urllib.request.Request(f"{self.api}/api/v0/{path}", data=body, headers=headers, method="POST")
        with urllib.request.urlopen(request, timeout=self.timeout) as answer:
            return json.loads(answer.read() or b"{}")

    def put(self, data: bytes) -> str:
        """Add and pin; returns the content identifier."""
        border = uuid.uuid4().hex
        body = b"".join([f'--{border}\r\nContent-Disposition: form-data; name="file"; filename="blob"\r\n\r\n'.encode(), data, f"\r\n--{border}--\r\n".encode()])
        cid = self._post("add?cid-version=1&raw-leaves=true", body, **{"Content-Type": f"multipart/form-data; boundary={border}"})["Hash"]
        self._post(f"pin/add?arg={cid}")
        return cid

    def get(self, cid: str) -> bytes:
        with urllib.request.urlopen(f"{self.gateway}/ipfs/{cid}", timeout=self.timeout) as answer:
            return answer.read()

    def delete(self, cid: str) -> None:
        """Unpin; the network keeps what others pin."""
        self._post(f"pin/rm?arg={cid}")

    def exists(self, cid: str) -> bool:
        try:
            with urllib.request.urlopen(urllib.request.Request(f"{self.gateway}/ipfs/{cid}", method="HEAD"), timeout=self.timeout):
                return True
        except urllib.error.HTTPError as error:
            if error.code == 404:
                return False
            raise

    def frame(self, cids: DataFrame) -> DataFrame:
        """(cid, data) of a table of identifiers, fetched by the executors."""

        def fetch(batches) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for cid in batch.column(0).to_pylist():
                    yield pa.RecordBatch.from_arrays([pa.array([cid]), pa.array([self.get(cid)], pa.binary())], names=["cid", "data"])

        return cids.select("cid").mapInArrow(fetch, "cid string, data binary")
