"""A network of its own for tests."""


def fetch(url):
    if "bad" in url:
        raise OSError("refused")
    return {"status": 200, "render_status": 200, "html": f"<title>{url}</title>"}
