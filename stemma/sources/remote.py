"""Query and wiki services over HTTP: requests with retries, through a transport that tests replace.

A transport takes (method, url, headers, body) and returns (status, headers, body). Replies are handed on as JSON text, to
be parsed by Spark with the readers of saved replies.
"""

from __future__ import annotations

import json
import time
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Callable
from dataclasses import dataclass, field

from stemma.sources.knowledge import NAME_TYPES, OFFSET_LIMIT

#: Addresses, tries, waits in seconds.
SPARQL_URL, API_URL, USAGE_URL = "https://query.wikidata.org/sparql", "https://www.wikidata.org/w/api.php", "https://www.behindthename.com/api"
SPARQL_TRIES, API_TRIES, LONGEST_WAIT = 10, 6, 60.0
SPARQL_WAIT, API_WAIT = 5.0, 3.0
USAGE_TRIES, USAGE_WAIT = 10, 60.0
#: The properties of a type, of an item said to be the same, of a native label and of a language.
TYPE, SAME_AS, NATIVE, LANGUAGE = "P31", "P460", "P1705", "P407"
AGENT = "stemma/1.0 (names and their relations)"

Transport = Callable[[str, str, dict, bytes | None], tuple[int, dict, bytes]]


class SourceTimeout(RuntimeError):
    """A query that the service gave up on, again and again."""


def over_http(method: str, url: str, headers: dict, body: bytes | None) -> tuple[int, dict, bytes]:
    request = urllib.request.Request(url, data=body, headers=headers, method=method)
    try:
        with urllib.request.urlopen(request, timeout=90) as reply:
            return reply.status, {k.lower(): v for k, v in reply.headers.items()}, reply.read()
    except urllib.error.HTTPError as e:
        return e.code, {k.lower(): v for k, v in e.headers.items()}, e.read()


def _busy(status: int) -> bool:
    return status == 429 or status >= 500


@dataclass
class Remote:
    transport: Transport = over_http
    sleep: Callable[[float], None] = time.sleep
    waits: list[float] = field(default_factory=list)

    def _wait(self, seconds: float) -> None:
        self.waits.append(seconds)
        self.sleep(seconds)

    def sparql(self, query: str, tries: int = SPARQL_TRIES) -> str:
        """A query's result document. A busy or failing service is asked again after longer and longer waits."""
        for n in range(tries):
            status, _, body = self.transport("POST", f"{SPARQL_URL}?format=json", {"Content-Type": "application/sparql-query", "Accept": "application/sparql-results+json", "User-Agent": AGENT}, query.encode())
            if 200 <= status < 300:
                return body.decode()
            if not _busy(status):
                raise RuntimeError(f"the query failed ({status}): {body.decode(errors='replace')[:300]}")
            self._wait(min(LONGEST_WAIT, SPARQL_WAIT * 2**n))
        raise SourceTimeout("the query failed again and again")

    def api(self, **params: str) -> str:
        """A reply of the wiki's API; an error in the reply counts as a failed try."""
        url, failed = f"{API_URL}?{urllib.parse.urlencode(params | {'format': 'json'})}", None
        for n in range(API_TRIES):
            wait = min(LONGEST_WAIT, API_WAIT * 2**n)
            try:
                status, headers, body = self.transport("GET", url, {"Accept": "application/json", "User-Agent": AGENT}, None)
                if _busy(status):
                    failed = RuntimeError(f"the API is busy ({status})")
                    self._wait(float(headers["retry-after"]) if "retry-after" in headers else wait)
                    continue
                error = json.loads(body).get("error")
                if not error:
                    return body.decode()
                failed = RuntimeError(f"the API says {error.get('code')}: {error.get('info')}")
            except (OSError, ValueError) as e:
                failed = e
            if n < API_TRIES - 1:
                self._wait(wait)
        raise failed

    def search(self, type_qid: str, offset: int, size: int) -> str:
        if offset >= OFFSET_LIMIT:
            raise ValueError(f"the search API gives no page from offset {OFFSET_LIMIT} on")
        return self.api(action="query", list="search", srsearch=f"haswbstatement:{TYPE}={type_qid}", srnamespace="0", srlimit=str(size), sroffset=str(offset), srinfo="totalhits", srprop="")

    def entities(self, qids: list[str]) -> str:
        return self.api(action="wbgetentities", ids="|".join(qids), props="labels|descriptions", languages="en|mul")

    def usage(self, what: str, name: str, key: str) -> str | None:
        """A reply of the usage service (what: lookup or related); none if the service doesn't know the name. A busy or failing
        service is asked again after a minute."""
        for _ in range(USAGE_TRIES):
            status, _, body = self.transport("GET", f"{USAGE_URL}/{what}.json?{urllib.parse.urlencode({'name': name, 'key': key})}", {"Accept": "application/json", "User-Agent": AGENT}, None)
            if status == 404:
                return None
            if status < 400:
                return body.decode()
            if not _busy(status):
                break
            self._wait(USAGE_WAIT)
        raise RuntimeError(f"the usage service failed ({status})")


def _select(of: str, where: str, tail: str = "") -> str:
    return f"SELECT DISTINCT {of} WHERE {{ {where} }} {tail}".strip()


_ITEM = "?item ?itemLabel ?nativeLabel ?langLabel ?genderLabel ?description"
_MORE = (f'?item rdfs:label ?itemLabel FILTER(LANG(?itemLabel) = "en") OPTIONAL {{ ?item wdt:{NATIVE} ?nativeLabel }} OPTIONAL {{ ?item wdt:{LANGUAGE} ?l . ?l rdfs:label ?langLabel FILTER(LANG(?langLabel) = "en") }} '
         'OPTIONAL { ?item schema:description ?description FILTER(LANG(?description) = "en") }')
_NUMBER = 'BIND(xsd:integer(STRAFTER(STR(?{0}), "/entity/Q")) AS ?n)'


def _types(types: tuple[str, ...], name: str = "type") -> str:
    return f"VALUES ?{name} {{ {' '.join(f'wd:{t}' for t in types or NAME_TYPES)} }}"


def names_window(low: int, high: int, *types: str) -> str:
    return _select(_ITEM, f"{_types(types)} ?item wdt:{TYPE} ?type . {_NUMBER.format('item')} FILTER(?n >= {low} && ?n < {high}) {_MORE}")


def names_page(offset: int, size: int, *types: str) -> str:
    return _select(_ITEM, f"{_types(types)} ?item wdt:{TYPE} ?type . {_MORE}", f"ORDER BY ?item LIMIT {size} OFFSET {offset}")


def names_prefix(type_qid: str, digits: str, after: int, size: int) -> str:
    return _select(_ITEM, f'?item wdt:{TYPE} wd:{type_qid} . FILTER(STRSTARTS(STRAFTER(STR(?item), "/entity/Q"), "{digits}")) {_NUMBER.format("item")} FILTER(?n > {after}) {_MORE}', f"ORDER BY ?n LIMIT {size}")


def edges_page(offset: int, size: int) -> str:
    return _select("?a ?b", f"{_types(())} ?a wdt:{TYPE} ?type . ?b wdt:{TYPE} ?type . ?a wdt:{SAME_AS} ?b FILTER(STR(?a) < STR(?b))", f"ORDER BY ?a ?b LIMIT {size} OFFSET {offset}")


def edges_window(low: int, high: int) -> str:
    return _select("?a ?b", f"{_types(())} ?a wdt:{TYPE} ?type . {_NUMBER.format('a')} FILTER(?n >= {low} && ?n < {high}) ?a wdt:{SAME_AS} ?b . ?b wdt:{TYPE} ?type FILTER(STR(?a) < STR(?b))")


def edges_of(qids: list[str]) -> str:
    return _select("?a ?b", f"VALUES ?a {{ {' '.join(f'wd:{q}' for q in qids)} }} ?a wdt:{SAME_AS} ?b . {_types(())} ?b wdt:{TYPE} ?type FILTER(STR(?a) < STR(?b))")
