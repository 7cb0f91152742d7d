"""Problem 3 on sentences written by hand: none of their frames, and few of their names, occur in the generator of training texts."""

import re

import pytest

from skein.llm import pii as P

NAMES = [
    "Katarzyna Wojcik", "Duncan McTavish", "Priyanka Venkataraman", "Oluwaseun Adeyemi", "Siobhan O'Reilly", "Tomasz Zielinski", "Bérénice Carpentier", "Friederike Obermaier", "Gonzalo Echeverría", "Ludovic de Montfort", "Annelies van der Berg", "Thandiwe Nkosi", "Harriet Q. Bloom",
    "Rosalind Whitaker", "Matthias Eichhorn", "Nadège Perrault", "Callum Fitzgerald", "Yevgenia Sokolova", "Ignatius Barlow", "Margarethe Schönfeld", "Desmond Achebe", "Zsófia Kertész", "Beatrix Lindqvist", "Théodore Vasseur",
]
EMAILS = ["d.mctavish@lochside.co.uk", "priyanka.v@deccan.example", "bcarpentier@atelier-nord.fr", "wojcik_kasia@poczta.example.org", "harriet.bloom+news@inkwell.com", "friederike@obermaier.de", "tnkosi77@capemail.test", "s.oreilly [at] shannon [dot] example", "gonzalo.e (at) pampas.example.net", "zkertesz at duna dot example"]
PHONES = ["415-555-0132", "0171 5550123", "+44 161 496 0345", "+33 6 39 98 12 34", "01 99 00 47 58", "(503) 555-0119", "+49 30 23125 014", "+1 808 555 0150", "+61 491 570 156", "07700 900461"]
IDS = [("SSN", "219-09-9999"), ("passport", "K84920173"), ("NIR", "1 85 05 78 006 084 36"), ("Steuer-ID", "48 036 952 129"), ("national insurance", "AB123456C"), ("DNI", "12345678Z"), ("social security number", "078-05-1120"), ("carte d'identité", "880692310285"), ("passeport", "09AT51284"), ("Personalausweis", "T22000129")]
PLACES = ["221 Baker Street", "17 Elmhurst Avenue", "8 rue des Lilas", "54 bis boulevard Voltaire", "Goethestraße 12", "Am Kirchberg 3", "1600 Sycamore Drive, Apt 4B", "29 Queen's Road", "112 avenue de la République", "Lindenallee 45a", "73 Harbour Terrace", "3 impasse du Moulin"]

FRAMES = [
    "{n} spilled coffee on the router again.", "Could somebody remind {n} to water the plants?", "The jury found {n} not guilty.", "Goal scored by {n} in the 83rd minute", "{n} was my chemistry teacher.", "Photo credit: {n}", "In memory of {n}, 1931-2004.", "The violin belonged to {n} before the war.",
    "Happy birthday, {n}!", "Votre conseillère est {n}.", "La maison de {n} est à vendre.", "Gestern hat {n} den Schlüssel verloren.", "Die Rechnung ging an {n} zurück.", "Elected treasurer: {n}", "{n} coached the under-12 side for years.", "I borrowed a ladder from {n} last weekend.",
    "Witness statement of {n}:", "{n} phoned while you were out.", "Nobody has seen {n} since the party.", "The scholarship went to {n}.", "Translated by {n}", "The keys are with {n} downstairs.",
    "Drop a line at {e} when you are back.", "RSVP {e}", "Questions? {e}", "My new address is {e}, the old one is dead.", "Bitte Bewerbungen an {e} senden", "Pour toute réclamation : {e}", "unsubscribe {e} from the list", "forwarded to {e} last night", "The invoice bounced from {e}.", "{e} has not confirmed yet",
    "You can leave a voicemail at {p}.", "Hotel reception: {p}", "In case of fire dial {p}", "Notruf des Hausmeisters: {p}", "Le plombier répond au {p}", "{p} is my work number", "She gave me {p} but nobody picks up.", "Taxi {p}", "text STOP to {p}", "The clinic's line, {p}, was busy",
    "The clerk copied {l} {i} into the ledger.", "Please redact {l} {i} before publishing.", "Employee card lists {l}: {i}", "{l} {i} was stolen in Lisbon", "He read out his {l}, {i}, twice.", "visa form, {l} {i}, page 2", "On the photocopy one can read {l} {i}.", "Lost property: {l} {i}", "New hire, {l} = {i}", "customs asked for {l} {i}",
    "The parcel was left at {a} with a neighbour.", "Our new studio opened at {a}.", "Fire reported near {a} at dawn", "Notre cabinet déménage au {a}.", "Das Paket liegt in der {a}.", "Meet me in front of {a}", "Estate sale: {a}, two bedrooms", "The taxi stopped outside {a}.", "He grew up at {a}.", "Plumber needed, {a}", "The burglar entered {a} by the window.",
    "{n} can be found at {a}.", "Caller {n}, {p}, complained about noise.", "{n} registered with {e}", "Guest list: {n}, {n2}", "{n} married {n2} in June.", "Between {n} and {n2} there is no love lost.", "{n}'s {l} is {i}.", "Heir: {n}, {a}",
]
HARMLESS = [
    "We spent a week in San Francisco.", "Parliament Hill was closed for snow.", "Machine Learning is not magic.", "Apache Spark reads Parquet files.", "The Golden Gate Bridge is painted all year.", "New Zealand won again.", "Green Tea and Black Coffee cost the same.", "Chapter Seven is missing.",
    "The Board Room is booked until noon.", "Customer Success and Field Sales swapped floors.", "Monday Morning stand-ups are cancelled.", "Great Expectations is on the list.", "See the Getting Started guide.", "Central Park is full of runners.", "Die Deutsche Bahn ist verspätet.", "La Banque Postale a fermé.",
    "Error 502-1188 came back twice.", "The meter shows 004821 kWh.", "Order 884-221-9034 was cancelled", "Invoice 2023-000482 is overdue", "ISBN 978-3-16-148410-0", "Backup took 1834 seconds for 20481 files", "Ping 10.42.0.19 from node 7", "Release 3.11.4 fixes it", "commit 9fceb02d0ae598e95dc970b74767f19372d61af8", "Deadline 2025-03-31 17:00",
    "ssh pi@raspberry.local", "git clone git@code.example.org:team/repo.git", "docker pull registry.example.com/base@sha256", "npm add @types/node", "postgres://reader:pw@db.example.com:5432/sales", "@pytest.fixture runs first", "ops@pager.example.com gets the alert",
    "12 Angry Men is a film.", "5 Star Hotels are rare here.", "Route 66 is long.", "Platz 4 reicht uns nicht", "Take 2 Blue Pills", "Room 101 is empty.", "Seite 12 Absatz 3", "3 Way Merge failed", "7 Main Points were made",
]


def cases():
    """Each frame three times, with other values each time."""
    out, k = [], 0
    for frame in FRAMES:
        for _ in range(3):
            values = {"n": NAMES[k % len(NAMES)], "n2": NAMES[(k + 7) % len(NAMES)], "e": EMAILS[k % len(EMAILS)], "p": PHONES[k % len(PHONES)], "l": IDS[k % len(IDS)][0], "i": IDS[k % len(IDS)][1], "a": PLACES[k % len(PLACES)]}
            kinds = {"n": "name", "n2": "name", "e": "email", "p": "phone", "i": "id_number", "a": "address"}
            out.append((frame.format(**values), {(kinds[s], values[s]) for s in re.findall(r"{(\w+)}", frame) if s in kinds}))
            k += 5
    return out + [(t, set()) for t in HARMLESS]


def scores(found_in):
    tried = cases()
    found = [{(P.TYPES[k], t[a:b]) for k, a, b, _ in f} for (t, _), f in zip(tried, found_in([t for t, _ in tried]), strict=True)]
    out = {}
    for kind in P.TYPES:
        want = {(i, x) for i, (_, w) in enumerate(tried) for x in w if x[0] == kind}
        got = {(i, x) for i, g in enumerate(found) for x in g if x[0] == kind}
        out[kind] = (2 * len(want & got) / max(1, len(want) + len(got)), sorted((x[1], tried[i][0]) for i, x in want - got), sorted((x[1], tried[i][0]) for i, x in got - want))
    return out


@pytest.fixture(scope="module")
def model():
    return P.trained()


def test_sentences_that_no_frame_of_training_resembles(model):
    assert len(cases()) > 250
    for kind, (f1, lost, wrong) in scores(lambda texts: P.find(texts, model)).items():
        assert f1 >= 0.9, (kind, f1, lost[:8], wrong[:8])
