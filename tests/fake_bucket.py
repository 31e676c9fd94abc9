"""A small S3-compatible server for tests: conditions, ranges, pages, multipart uploads, faults."""

import hashlib
import re
import threading
import xml.etree.ElementTree as ET
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs, unquote, urlsplit


class Bucket:
    def __init__(self, page=3):
        self.objects, self.uploads, self.faults, self.log, self.page, self.lock = {}, {}, [], [], page, threading.Lock()
        bucket = self

        class Handler(BaseHTTPRequestHandler):
            protocol_version = "HTTP/1.1"

            def log_message(self, *_):
                pass

            def serve(self):
                url = urlsplit(self.path)
                body = self.rfile.read(int(self.headers.get("Content-Length") or 0))
                key = unquote(url.path).split("/", 2)[2] if url.path.count("/") > 1 else ""
                query = {k: v[0] for k, v in parse_qs(url.query, keep_blank_values=True).items()}
                with bucket.lock:
                    status, headers, data = bucket.answer(self.command, key, query, self.headers, body)
                self.send_response(status)
                for k, v in headers.items():
                    self.send_header(k, v)
                if "Content-Length" not in headers:
                    self.send_header("Content-Length", str(len(data)))
                self.end_headers()
                if self.command != "HEAD":
                    self.wfile.write(data)

            do_GET = do_PUT = do_POST = do_DELETE = do_HEAD = serve

        self.server = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
        self.url = f"http://127.0.0.1:{self.server.server_port}"
        threading.Thread(target=self.server.serve_forever, daemon=True).start()

    def tag(self, key):
        data, parts = self.objects[key]
        return f'"{hashlib.md5(data).hexdigest()}{f"-{parts}" if parts else ""}"'

    def fill(self, files):
        for k, v in files.items():
            self.objects[k] = (v, 0)

    def error(self, status, code):
        return status, {}, f"<Error><Code>{code}</Code><Message>no</Message></Error>".encode()

    def answer(self, method, key, query, headers, body):
        self.log.append((method, key, dict(query), headers.get("Range"), headers.get("If-Match"), headers.get("If-None-Match")))
        if "AWS4-HMAC-SHA256" not in headers.get("Authorization", "") or headers.get("x-amz-content-sha256") != hashlib.sha256(body).hexdigest():
            return self.error(403, "AccessDenied")
        for fault in self.faults:
            if fault[0] == method and re.search(fault[1], key) and fault[3] > 0:
                fault[3] -= 1
                return self.error(*fault[2])
        if method == "GET" and "list-type" in query:
            return 200, {}, self.listing(query)
        if method == "POST" and "delete" in query:
            failed = ""
            for node in ET.fromstring(body).iter("Key"):
                if "locked" in node.text:
                    failed += f"<Error><Key>{node.text}</Key><Code>AccessDenied</Code><Message>no</Message></Error>"
                else:
                    self.objects.pop(node.text, None)
            return 200, {}, f"<DeleteResult>{failed}</DeleteResult>".encode()
        if method == "POST" and "uploads" in query:
            self.uploads["u1"] = {}
            return 200, {}, b"<R><UploadId>u1</UploadId></R>"
        if method == "PUT" and "uploadId" in query:
            self.uploads[query["uploadId"]][int(query["partNumber"])] = body
            return 200, {"ETag": f'"{hashlib.md5(body).hexdigest()}"'}, b""
        if method == "POST" and "uploadId" in query:
            numbers = [int(n.text) for n in ET.fromstring(body).iter("PartNumber")]
            parts = self.uploads.pop(query["uploadId"])
            self.objects[key] = (b"".join(parts[n] for n in numbers), len(numbers))
            return 200, {}, b"<R/>"
        if method == "DELETE":
            self.uploads.pop(query.get("uploadId"), None)
            return 204, {}, b""
        there = key in self.objects
        if method == "PUT":
            if headers.get("If-None-Match") == "*" and there:
                return self.error(412, "PreconditionFailed")
            if headers.get("If-Match") and (not there or headers["If-Match"] != self.tag(key)):
                return self.error(412, "PreconditionFailed")
            self.objects[key] = (body, 0)
            return 200, {"ETag": self.tag(key)}, b""
        if not there:
            return self.error(404, "NoSuchKey")
        data, tag = self.objects[key][0], self.tag(key)
        if headers.get("If-Match") and headers["If-Match"] != tag:
            return self.error(412, "PreconditionFailed")
        if method == "HEAD":
            return 200, {"ETag": tag, "Content-Length": str(len(data))}, b""
        m = re.fullmatch(r"bytes=(\d+)-(\d+)", headers.get("Range") or "")
        return (206, {"ETag": tag}, data[int(m[1]) : int(m[2]) + 1]) if m else (200, {"ETag": tag}, data)

    def listing(self, query):
        keys = sorted(k for k in self.objects if k.startswith(query.get("prefix", "")))
        at = int(query.get("continuation-token", 0))
        page = keys[at : at + self.page]
        more = at + self.page < len(keys)
        rows = "".join(f"<Contents><Key>{k}</Key><ETag>{self.tag(k).replace(chr(34), '&quot;')}</ETag><Size>{len(self.objects[k][0])}</Size></Contents>" for k in page)
        token = f"<NextContinuationToken>{at + self.page}</NextContinuationToken>" if more else ""
        return f'<ListBucketResult xmlns="http://s3.amazonaws.com/doc/2006-03-01/">{rows}<IsTruncated>{str(more).lower()}</IsTruncated>{token}</ListBucketResult>'.encode()
