import io
import json
import os

import pytest

from loomtext.sources.completions import Completions
from loomtext.sources.single import read_file, read_stream, write_file


def test_files(tmp_path):
    source, link, out = (str(tmp_path / n) for n in ("in.log", "link.log", "out.log"))
    (tmp_path / "in.log").write_bytes(b"a\xff\n")
    os.symlink(source, link)
    text, found = read_file(source, 3)
    assert text == "a�\n"
    for path, most in ((source, 2), (str(tmp_path), 99), (link, 99)):
        with pytest.raises((ValueError, OSError)):
            read_file(path, most)
    with pytest.raises(ValueError):
        read_stream(io.BytesIO(b"abcd"), 3)
    write_file(out, "one", found)
    write_file(out, "two", found)
    assert open(out).read() == "two" and os.stat(out).st_mode & 0o777 == 0o600
    os.link(source, str(tmp_path / "hard.log"))
    for path in (source, link, str(tmp_path), str(tmp_path / "hard.log")):
        with pytest.raises(ValueError):
            write_file(path, "no", found)
    assert not [n for n in os.listdir(tmp_path) if n.endswith(".tmp")] and open(source, "rb").read() == b"a\xff\n"


def test_completions():
    sent = []

    def transport(url, headers, body, seconds):
        sent.append((url, headers, json.loads(body), seconds))
        return 200, json.dumps({"id": "r", "choices": [{"message": {"content": "hi"}}], "usage": {"prompt_tokens": 3}})

    api = Completions("https://example.test/v1/", "key", transport, {"authorization": "other", "X-A": "1"})
    got = api.complete("m", [{"role": "user", "content": "x"}], max_tokens=5, thinking=False)
    url, headers, body, seconds = sent[0]
    assert url == "https://example.test/v1/chat/completions" and seconds == 30
    assert headers == {"X-A": "1", "Authorization": "Bearer key", "Content-Type": "application/json"}
    assert body == {"model": "m", "messages": [{"role": "user", "content": "x"}], "max_tokens": 5, "thinking": {"type": "disabled"}}
    assert got["text"] == "hi" and got["model"] == "m" and got["usage"]["input_tokens"] == 3 and got["usage"]["cache_hit_tokens"] == 0
    assert "key" not in repr(api).replace("api_key", "")
    for wrong in ({"base_url": "ftp://a"}, {"api_key": ""}, {"timeout_ms": 0}, {"max_messages": 0}):
        with pytest.raises(ValueError):
            Completions(**({"base_url": "http://a", "api_key": "k", "transport": transport} | wrong))
    with pytest.raises(ValueError):
        Completions("http://a", "k", transport, max_characters=5).complete("m", [{"role": "user", "content": "x"}])
    with pytest.raises(RuntimeError, match="HTTP 500: a b$"):
        Completions("http://a", "k", lambda *_: (500, "a\nbc"), max_error_characters=3).complete("m", [])
