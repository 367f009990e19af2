import functools

import pytest

from aerolith.llm.privacy import GIVEN, find, plain, weights
from aerolith.llm.privacy_training import FRAMES as _FRAMES

# Phrases that are no training frame, with first names that GIVEN lacks; [ ] marks names.
TEXTS = [
    "The plumber, [Kwame Osterfeld], fixed the valve on Tuesday.", "We handed the report over to [Zdenka Morvath] yesterday.", "Our new colleague [Tadeusz Brenlow] starts in May.", "[Ingeborg Halvick] wrote the second chapter.",
    "According to the minutes, [Oluwaseun Partridge] left early.", "Ask [Yasmine Kerhoat] about the spare key.", "Le gardien, [Ludivine Taskern], a fermé la grille.", "Nous avons rencontré [Hippolyte Varnoux] sur le chantier.",
    "La clé est chez [Eulalie Grandmont] depuis lundi.", "D'après [Thaddée Lormel], la toiture fuit.", "Der Hausmeister [Gottlieb Ahrenkamp] kennt den Keller.", "Wir haben [Roswitha Tannert] im Hof getroffen.",
    "Bericht von [Detlef Quandorf] liegt bei.", "El portero, [Ramiro Castelblan], cerró la verja.", "Hablamos con [Rosalinda Urquez] en la obra.", "Según [Baltasar Meneiro], el techo gotea.",
    "The contract was drafted by [Nkechi Dunmore].", "[Fergus Oakhollow] will read the meters.", "Je confie le dossier à [Sidonie Brasquet].", "Photo prise par [Anatole Wierzba] en avril.",
    "The Tramontane blew all night over the Camargue.", "Le pont Mirabeau reste ouvert aux piétons.", "Die Station Hohenpeissenberg misst seit 1781.", "El barrio Salamanca registra más calor.",
]


@functools.cache
def counts() -> tuple[int, int, int]:
    """Names found, found wrongly, lost."""
    w, hit, wrong, lost = weights(), 0, 0, 0
    for marked in TEXTS:
        a, text = marked.find("["), marked.replace("[", "").replace("]", "")
        gold = {(a, marked.find("]") - 1, "name")} if a >= 0 else set()
        got = {(s.start, s.end, s.kind) for s in find(text, w)}
        hit, wrong, lost = hit + len(got & gold), wrong + len(got - gold), lost + len(gold - got)
    return hit, wrong, lost


@pytest.mark.parametrize("marked", TEXTS)
def test_texts_are_unseen(marked):
    if "[" in marked:
        name = marked[marked.find("[") + 1 : marked.find("]")]
        assert plain(name.split()[0]) not in GIVEN
        assert marked.replace(f"[{name}]", "{name}") not in _FRAMES


def test_counts_add_up():
    """p9_found: the figures in the README."""
    hit, wrong, lost = counts()
    assert hit + lost == 20
    print(hit, wrong, lost)
