import json
import threading
import urllib.error
import urllib.request

import pytest

from notelake.api import Notes
from notelake.service import Service, serve


@pytest.fixture(scope="module")
def service(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("vault")
    (root / "a.md").write_text("# A\nproject one, mail x@y.example")
    (root / "b.md").write_text("# B\nsecond project\n\n## C\nmore")
    s = Service(Notes(spark, str(tmp_path_factory.mktemp("index"))), "key", {"v": str(root)}, ("http://a.example",))
    assert s.rebuild_index() == {"inserted": 2}
    return s


def test_http(service):
    server = serve(service, port=0)
    threading.Thread(target=server.serve_forever, daemon=True).start()

    def get(path, **headers):
        try:
            r = urllib.request.urlopen(urllib.request.Request(f"http://127.0.0.1:{server.server_port}{path}", headers=headers))
            return r.status, json.loads(r.read())
        except urllib.error.HTTPError as e:
            return e.code, json.loads(e.read())

    key = {"X-API-Key": "key"}
    api = "/api/v1"
    assert get(f"{api}/health") == (200, {"status": "ok", "version": 1}) and get(f"{api}/stats")[0] == 401 and get(f"{api}/stats", Authorization="Bearer key")[0] == 200
    status, found = get(f"{api}/search?q=project&limit=1&mode=fts", **key)
    assert status == 200 and found["count"] == len(found["results"]) == 1 and found["total"] == 2 and found["next_cursor"] and (found["offset"], found["limit"]) == (0, 1)
    status, rest = get(f"{api}/search?q=project&limit=1&offset=1&backlinks=false&alpha=0.5", **key)
    assert rest["mode"] == "fts" and rest["results"][0]["file_path"] != found["results"][0]["file_path"]
    assert get(f"{api}/search?q=", **key)[0] == get(f"{api}/search?q=a&mode=x", **key)[0] == get(f"{api}/list?limit=x", **key)[0] == get(f"{api}/search?q=a&alpha=x", **key)[0] == 400
    assert get("/nothing", **key)[0] == get(f"{api}/read?vault=w&path=no.md", **key)[0] == 404 and get(f"{api}/read?vault=v&path=../b.md", **key)[0] == 400
    assert get(f"{api}/search?q=a&mode=vec", **key)[0] == 500
    assert get(f"{api}/read?vault=v&path=b.md", **key)[1]["content"].startswith("# B\nsecond project")
    assert [f["path"] for f in get(f"{api}/list", **key)[1]["files"]] == ["a.md", "b.md"]
    assert get(f"{api}/stats", **key)[1]["total_chunks"] == 3
    page = urllib.request.urlopen(f"http://127.0.0.1:{server.server_port}/ui")
    assert page.headers["Content-Type"].startswith("text/html") and b"/api/v1/search" in page.read()
    for origin, ok in (("http://a.example", True), ("http://b.example", False)):
        r = urllib.request.urlopen(urllib.request.Request(f"http://127.0.0.1:{server.server_port}{api}/health", method="OPTIONS", headers={"Origin": origin}))
        assert r.status == 204 and (r.headers["Access-Control-Allow-Origin"] == origin) is ok
    server.shutdown()


def test_tools(service):
    assert "[EMAIL]" in service.search_local_notes("mail") and service.search_local_notes("x", mode="vec").startswith("Vector")
    assert service.index_status()["total_files"] == 2 and service.rebuild_index(from_scratch=True) == {"inserted": 2}
    at = service.notes.store.table("chunks").where("content = 'more'").first().chunk_id
    assert service.get_surrounding_context(at) == "second project\n\n>>> more"
