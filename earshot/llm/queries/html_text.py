"""op8: main text of all ``pages``."""

from earshot.llm.html_text import extract, fit
from earshot.llm.registry import query
from earshot.llm.store import table


@query("op8_main_text")
def op8_main_text(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return extract(pages, fit(pages))
