"""Training documents for llm.pii: sentences with invented personal data, and look-alikes that are none.

Everything is put together at random from the fixed values below, which come from general knowledge (frequent names, formats
of numbers and addresses by country, everyday sentences); the gold spans come with the text.  Every third frame, name and
street can be held out (``part``), as can whole languages.
"""

from __future__ import annotations

import random
import unicodedata

# Frequent given names and family names of several languages.
GIVEN = (
    "james john robert michael william david richard joseph thomas daniel matthew mark paul steven andrew george edward kevin ryan eric stephen scott benjamin samuel patrick jack oliver harry arthur simon peter ian callum owen liam "
    "mary patricia jennifer linda elizabeth susan jessica sarah karen lisa nancy margaret sandra emily michelle amanda rebecca laura helen amy anna emma olivia alice grace ruth charlotte sophie lucy hannah fiona freya "
    "hans klaus jürgen uwe stefan andreas tobias sebastian lukas jonas felix ursula monika petra sabine karin ingrid claudia anja birgit greta klara anselm "
    "jean pierre michel andré philippe nicolas julien antoine françois hugo louis marie nathalie isabelle sylvie catherine camille léa odile "
    "josé juan antonio manuel javier carlos miguel pablo diego mateo maría carmen ana isabel lucía elena pilar beatriz inés "
    "marco luca giulia chiara giovanni sofia joão lars erik nils sven søren astrid sigrid jan piotr agnieszka zofia pavel ivan dmitri olga natalia "
    "mohamed ahmed fatima aisha omar yusuf mehmet elif ravi priya arjun chidi kofi amina wei ming yuki noor idris"
)
FAMILY = (
    "smith jones taylor brown williams wilson johnson davies patel wright walker thompson white hughes edwards hall harris lewis jackson clarke turner müller schmidt schneider fischer weber meyer wagner becker schulz hoffmann koch richter klein wolf neumann zimmermann krüger "
    "bernard dubois petit durand leroy moreau laurent lefebvre garcía rodríguez gonzález fernández lópez martínez sánchez pérez gómez jiménez ruiz hernández díaz rossi russo ferrari esposito bianchi silva santos oliveira pereira "
    "andersson johansson karlsson nilsson hansen larsen olsen kowalski nowak novák horvat ivanova petrov yılmaz kaya demir khan singh sharma okafor mensah nguyen kim chen tanaka sato"
)
PARTICLES = ["van", "van der", "von", "de", "de la", "del", "da", "du", "zu", "van den", "di"]
# Street names and what follows or precedes them.
STREETS = {
    "en": ("High Park Queen's King's London Manor Maple Oak Cedar Elm Washington Lake Spring Bridge Abbey Windmill Albert Northgate Riverside Highfield".split(), "Street St. St Road Rd. Rd Avenue Ave. Ave Lane Ln Drive Dr. Court Ct Way Place Close Crescent Terrace Boulevard Blvd Square Row Hill Gardens Grove Mews Walk".split()),
    "de": ("Haupt Dorf Goethe Schiller Eichen Buchen Ahorn Brunnen Wiesen Feld Friedrich Amsel Tannen Mozart Ufer Post".split(), "straße strasse str. weg allee platz ring gasse damm ufer steig pfad".split()),
    "fr": (["de la République", "de la Paix", "Pasteur", "Jean Jaurès", "de l'Église", "des Écoles", "du Château", "de Verdun", "des Tilleuls", "Voltaire", "du Général Leclerc"], "rue avenue boulevard allée impasse quai place chemin passage cours route square".split()),
    "es": (["de la Constitución", "de Alcalá", "San Juan", "de la Iglesia", "del Sol", "de Cervantes", "Real", "de la Fuente", "de los Reyes", "Nueva"], ["Calle", "Avenida", "Plaza", "Paseo", "Camino", "C/", "Avda.", "Ronda", "Travesía"]),
}
DOMAINS = "acme initech globex contoso fabrikam umbrella wayne-law bluebird cityhall uni-nord bakery studio39 webmail office".split()
TLDS = "com org net de fr es co.uk eu io example example.com test".split()
# Frames of sentences around personal data, by language; {} is the place of the data.
NAME_FRAMES = {
    "en": ["I spoke with {}.", "{} will chair the session.", "Dear {},\n", "Thanks,\n{}\n", "{} called about the heating.", "Author: {}\n", "Patient: {}\n", "Prepared by {} in March.", "Sincerely,\n{}\n", "Mr {} signed it.", "Ms {} lives upstairs.", "the report of {} came late", "We met {} at noon.", "{}'s bicycle was stolen.", "A letter from {} arrived.", "cc {}\n",
           "To: {}\n", "{} and the others left early.", "She thanked {} for coming.", "contact = {}\n", '"owner": "{}"', "| {} | done |", "- {}\n", "({})", "{}: I will be late.", "{} wrote the first draft, and nobody read it.", "Witness: {}; sworn.", "# Letter to {}\n", "ask {} if it works", "name={} role=editor", "{} has moved the desk.", "Dr. {} is away.", "the car that {} sold last year", "{} thinks so too."],
    "de": ["Frau {} hat angerufen.", "Herr {} ist verreist.", "Das Schreiben ist von {} unterzeichnet.", "{} schreibt morgen.", "Sehr geehrte Frau {},\n", "Gestern kam {} zu spät.", "Viele Grüße\n{}\n", "Laut {} stimmt das.", "Wir danken {} für die Hilfe.", "Bearbeitet von {}.", "Dort arbeitet {} seit Jahren.", "Kontakt: {}\n"],
    "fr": ["M. {} est absent.", "Madame {} a téléphoné.", "La lettre est signée par {}.", "{} pense que oui.", "Chère {},\n", "Nous avons vu {} hier.", "D'après {}, tout va bien.", "Cordialement\n{}\n", "Rédigé par {}.", "Demandez à {} de venir.", "Auteur : {}\n"],
    "es": ["El señor {} está fuera.", "Doña {} llamó por teléfono.", "La carta la firma {}.", "{} cree que sí.", "Estimada {}:\n", "Vimos a {} el martes.", "Como dice {}, es cierto.", "Atentamente\n{}\n", "Escrito por {}.", "Pregunta a {} si viene.", "Autor: {}\n"],
}
PHONE_FRAMES = {
    "en": ["Ring {} in the morning.", "Call {} for details.", "Please call {} or write.", "reach us on {}.", "Phone {}\n", "mobile: {}\n", "tel:{}\n", "My number is {}, thanks.", "{} rang twice.", "fax {};", "You can text {} any time.", '"phone": "{}"', "| {} |", "or {}.", "{}\n", "Cell {} / office", "the line {} was dead"],
    "de": ["Telefon {}\n", "Ruf mich unter {} an.", "Mobil: {}\n", "Die Nummer {} ist besetzt.", "Fax {}\n", "oder {} am Abend."],
    "fr": ["Téléphone : {}\n", "Appelez-moi au {} demain.", "Mon numéro est le {}.", "Portable {}\n", "ou bien le {}."],
    "es": ["Teléfono: {}\n", "Llámame al {} mañana.", "Mi número es el {}.", "Móvil {}\n", "o bien el {}."],
}
ID_FRAMES = {
    "en": ["Social security number: {}\n", "SSN {} on file", "a copy of passport {}", "passport no. {} enclosed", "tax id {},", "NI number {} was given", "identity card {} found", "passport {} expires soon", "His tax number is {}.", "SSN: {}", "ID card {} was lost.", "NI number {} on the payslip", "They wrote {} on the back.", "{} is printed on his card.", "He gave {} as proof of who he is.", "passport number {};", "Taxpayer {}, born 1980.", "identity no. {}\n", "someone left {} in the chat", "We saw {} again in the copy.", "{} stands in the margin.", "the scan shows {} twice", "he typed {} here by mistake", "| {} |"],
    "de": ["Personalausweis {} ist abgelaufen.", "Ausweis {} wurde kopiert.", "Steuer-Nummer {} liegt vor.", "Ausweisnummer {}.", "Steuernummer: {}\n", "Reisepass Nr. {}\n", "Versicherungsnummer {} bitte angeben.", "Auf der Karte steht {}.", "Im Antrag wurde {} genannt.", "Im Anhang ist {} zu lesen.", "Jemand tippte {} hinein."],
    "fr": ["Passeport {} expiré.", "Pièce {} copiée.", "numéro fiscal {} fourni", "Sécurité sociale : {}\n", "Carte d'identité numéro {}.", "Son numéro fiscal est {}.", "Sur la carte on lit {}.", "Le formulaire contient {} en clair.", "On a tapé {} ici.", "Dans la marge, {} est visible."],
    "es": ["Pasaporte {} caducado.", "Documento {} copiado.", "DNI {} del cliente", "DNI: {}\n", "NIE {} del titular.", "Su número fiscal es {}.", "En la tarjeta pone {}.", "El formulario contiene {} a la vista.", "Alguien tecleó {} aquí.", "En el margen, {} es visible."],
}
MAIL_FRAMES = {
    "en": ["Mail me at {} today.", "E-mail: {}\n", "<{}>", "reply to {};", "{} bounced.", '"mail": "{}"', "mailto:{}", "Contact {} or the desk.", "| {} |", "address={} ok"],
    "de": ["Schreib mir an {} bitte.", "E-Mail: {}\n", "Die Adresse {} ist falsch."],
    "fr": ["Écrivez-moi à {} demain.", "Courriel : {}\n", "L'adresse {} est fausse."],
    "es": ["Escríbeme a {} mañana.", "Correo: {}\n", "La dirección {} es falsa."],
}
STREET_FRAMES = {
    "en": ["I live at {}.", "Address: {}\n", "The shop at {} is shut.", "{}\n", "Deliveries to {}, please.", "between {} and the river", "They bought {} in spring.", '"street": "{}"', "She moved to {}.", "the house {} burnt down"],
    "de": ["Ich wohne {}.", "Anschrift: {}\n", "Das Haus {} ist verkauft.", "Lieferung: {}, Erdgeschoss."],
    "fr": ["J'habite {}.", "Adresse : {}\n", "La maison du {} est vendue.", "Livraison : {}, premier étage."],
    "es": ["Vivo en {}.", "Dirección: {}\n", "La casa de {} se vendió.", "Envío a {}, bajo."],
}
OPENINGS = ["Yours,\n", "Bewerber ", "Ship to:\n", "person;", "| ", "Customer ", "Best wishes\n", "Herzlich\n", "Bien à vous\n", "Un abrazo\n", "{", "- "]
# What is numbered but belongs to no person, by language, and how such numbers are written (9 a digit, A a capital, x a hex letter).
THINGS = {
    "en": "invoice,order,ticket,build,release,revision,commit,hash,serial,batch,lot,part,shipment,parcel,case,version,issue,receipt,article,job,run,change,patch,item,model,contract".split(","),
    "de": "Rechnung,Bestellung,Auftrag,Charge,Artikel,Vorgang,Paket,Revision,Lieferung,Ticket,Version".split(","),
    "fr": "facture,commande,lot,article,dossier,colis,révision,livraison,ticket,version".split(","),
    "es": "factura,pedido,lote,artículo,expediente,paquete,revisión,entrega,ticket,versión".split(","),
}
THING_NUMBERS = ["9999999", "99999999", "999999999", "9999999999", "999-99-9999", "999 99 9999", "999.99.9999", "999999-9999", "2099-999-9999", "A999999", "A9999999", "AA999999", "AA9999999", "x999999", "x9999999", "x99999999", "x99999999x", "999999999x", "xx9999999", "xx99999999", "x99x9999", "99999999x", "9999999x", "99.999.999", "9999-9999", "999-9999-99", "99999999-A", "0999999-9999", "v9.99.9", "9999 9999", "999 999 999"]
THING_FRAMES = {
    "en": ["{T} {n} is overdue.", "{T} {n} failed.", "see {t} {n} for more", "{T} no. {n} was shipped.", "{T} {n} and {t} {n} differ.", "- {T} {n} sorts the rows.", "The {t} {n} came back.", "{T} {n}", "it closes {t} {n}.", "{T} {n} removed a line."],
    "de": ["{T} {n} ist offen.", "{T} {n} wurde bezahlt.", "siehe {T} {n}", "Die {T} {n} fehlt."],
    "fr": ["{T} {n} impayée.", "La {t} {n} est partie.", "voir {t} {n}", "{T} {n} reçue."],
    "es": ["{T} {n} pendiente.", "La {t} {n} salió ayer.", "ver {t} {n}", "{T} {n} recibida."],
}
OTHER_NUMBERS = ["It took 999999 ms, then 9999999 ms.", "between 9999999 and 9999999 rows", "99 999 999 bytes in 999 files", "host 99.99.9.999 port 9999", "ISBN 978-9-99999-999-9", "at 2025-09-09 the sum was 999.999.999", "total: 9,999,999", "shelves 999-9999 are empty", "pages 099-9999 were torn", "99999 99999 99999 votes", "99999999999999999999999999999 is long", "9999999 / 9999999", "seed=99999999", "pi is 3.99999999", "id_999999_9999999", "port 99999", "size 9999x9999"]
NOT_NAMES = {
    "en": ["The Riverside Museum reopens in June.", "{P} County has a new bridge.", "Golden Gate Edition sold well.", "Baker & Sons Ltd sent a bill.", "Project Silver Arrow was stopped.", "The {P} Chess Club won.", "Team Blue Whale lost.", "Sunrise Foods Inc. closed.", "Grace Period Rules changed.", "Mark Sheet Two is missing.", "the Victoria Line Station", "Operation Night Owl ended.", "# Annual Budget Review\n", "## Open Points And Next Steps\n", "## Hidden Costs\n", "# Weekly Sales Table For Staff\n", "{P} Vale\n", "{P} Town\n", "New {P}\n", "Early Bird Ticket prices rose.", "Windows Server Update", "Black Friday Week", "Title: Broken Garden Fence\n", "Status: In Progress\n", "The Old Mill Inn is full.", "Room Plan North", "{P} Library\n", "Monday Morning Call", "Berlin, Madrid and {P}", "Paris, France", "in May, June and July", "Tables, Chairs and Lamps", "Amber Falcon and Velvet Anchor are code names.", "Crystal Comet", "Iron Harvest Patch"],
    "de": ["Das Museum Nord öffnet bald.", "Die Firma Gold Stern GmbH zahlt.", "Am Dienstag öffnet Der Laden.", "Projekt Roter Adler ruht.", "Unter Druck gibt Die Leitung nach.", "# Offene Punkte Und Termine\n", "Stadt {P}\n", "Der Plan Mai ist fertig.", "Im Herbst prüft Das Amt alles."],
    "fr": ["Le Musée Rouge rouvre.", "La Société Étoile Bleue paie.", "Projet Aigle Noir arrêté.", "# Points Ouverts Et Dates\n", "Ville de {P}\n", "Lune Verte est un produit.", "Le Plan Mai est prêt."],
    "es": ["El Museo Rojo abre.", "La Empresa Estrella Verde paga.", "Proyecto Águila Negra parado.", "# Puntos Abiertos Y Fechas\n", "Ciudad de {P}\n", "Luna Roja es un producto.", "El Plan Mayo está listo."],
}
# German nouns, and nouns and colours that titles and code names are made of.
NOUNS_DE = "Hund Ball Wagen Brief Garten Schrank Lehrer Baum Schlüssel Zug Tisch Wald Kuchen Vertrag Fehler Antrag Termin Betrag Motor Kunde Nachbar Stuhl Kanal Preis Kalender Keller".split()
VERBS_DE = "sieht findet kennt ersetzt verliert zeigt verschiebt braucht prüft vergisst".split()
CODES = {
    "en": ("{b} {a}", "Moon Star Horse Forest River Mountain Falcon Lion Bridge Stone".split(), "Red White Black Golden Grey Crimson Purple Bright".split(), ["{c} is a code name.", "{c} was delayed.", "the {c} version", "Plan {c} and plan B", "{c} and {c2} are products."]),
    "de": ("{a}{a2} {b}", "Gold Stern Wald Adler Fluss Berg Falke Löwe".split(), "Reihe Serie Edition Ausführung Linie".split(), ["Die {c} ist ein Produkt.", "Wir kennen die {c} gut.", "Die {c} kommt bald."]),
    "fr": ("{a} {b}", "Lune Étoile Cheval Forêt Rivière Montagne Faucon Lion".split(), "Rouge Blanc Noir Doré Gris Pourpre".split(), ["{c} est un produit.", "Le projet {c} attend.", "{c} sort en juin."]),
    "es": ("{a} {b}", "Luna Estrella Caballo Bosque Río Montaña Halcón León".split(), "Roja Blanca Negra Dorada Gris Púrpura".split(), ["{c} es un producto.", "El proyecto {c} espera.", "{c} sale en junio."]),
}
NOT_MAIL = ["Use left-pad@9.9.9 instead.", "root@server-99 is full.", "Follow @city_news now.", "@property stays above it.", "npm i core@99.9", "lock tools@v9.9.9 now", "mylib@v9.99.9", "kit@v99.9", "user@host:~$ ls", "at 9@home each"]
NOT_STREETS = ["Line 9 of the Street View code", "Track 99 at the station", "Der Ring 9 der Serie", "La place 9 du parking", "La plaza 99 del aparcamiento", "Way 9 is blocked", "in 9 ways, 9 places and 99 rows", "Chapter 9 Road Safety", "Between 09:00 and 99 trucks came down the road."]
PLAIN = {
    "en": "The list is long,Nobody reads it,We lost the key again,Rain came in the evening,It costs less than before,A cup of tea helps,The second try worked,Both copies are old,Prices rose in May,Our Garden is small".split(","),
    "de": "Die Liste ist lang,Niemand liest sie,Am Abend kam Regen,Der zweite Versuch gelang,Beide Kopien sind alt,Im Mai stiegen Die Preise".split(","),
    "fr": "La liste est longue,Personne ne la lit,La pluie est venue,Le second essai a réussi,Les deux copies sont vieilles".split(","),
    "es": "La lista es larga,Nadie la lee,Por la tarde llovió,El segundo intento salió,Las dos copias son viejas".split(","),
}
_ONSETS = "b br c ch d dr f g gr h j k kr l m n p pr r s sch st t tr v w z".split()
_VOWELS = "a e i o u au ei ie ö ü é".split()
_CODAS = "ck g l ll m n nd nn r rd rs s sk ss t tt x".split()
_ENDINGS = "er ner son sen man ley ton ford ham ini ero ez ova ski dal gren aud eau ić oğlu well stein".split()
_GIVEN_ENDINGS = "a a a o e i ie en an in us el y ke is as".split()
LANGUAGES = ("en", "de", "fr", "es")


class Maker:
    """Builds texts piece by piece and keeps the gold spans.  part: None for all values, False without those held out, True
    for those alone; languages: of the frames."""

    def __init__(self, seed: int, part: bool | None = None, languages: tuple[str, ...] = LANGUAGES):
        self.r = random.Random(seed)
        self.part, self.languages = part, languages
        self.given, self.family = self.kept(GIVEN.split()), self.kept(FAMILY.split())

    def kept(self, values: list[str]) -> list[str]:
        return values if self.part is None else [v for i, v in enumerate(values) if (i % 3 == 2) == self.part]

    def one_of(self, table: dict[str, list[str]]) -> str:
        return self.r.choice(self.kept(table[self.r.choice(self.languages)]))

    def digits(self, n: int) -> str:
        return "".join(self.r.choices("0123456789", k=n))

    def filled(self, pattern: str) -> str:
        """A pattern with 9, A and x filled in; a first 9 is no 0."""
        out = []
        for i, c in enumerate(pattern):
            out.append(self.r.choice("123456789" if not i else "0123456789") if c == "9" else self.r.choice("ABCDEFGHKLMNPRSTXZ") if c == "A" else self.r.choice("abcdef") if c == "x" else c)
        return "".join(out)

    def invented(self) -> str:
        r = self.r
        s = r.choice(_ONSETS) + r.choice(_VOWELS) + r.choice(_CODAS)
        if r.random() < 0.4:
            s += r.choice(_VOWELS) + r.choice(_CODAS)
        return (s + r.choice(_ENDINGS)).capitalize()

    def rare(self) -> str:
        """A given name that is in no list."""
        r = self.r
        return (r.choice([*_ONSETS, "", ""]) + r.choice(_VOWELS) + r.choice(["l", "n", "m", "r", "s", "v", "nd", "ll", "th", "d", "k", "ck"]) + r.choice(["", "", r.choice(_VOWELS) + r.choice(["l", "n", "m", "r", "s", "d"])]) + r.choice(_GIVEN_ENDINGS)).capitalize()

    def surname(self) -> str:
        r = self.r
        s = self.invented() if r.random() < 0.6 else r.choice(self.family).capitalize()
        if r.random() < 0.06:
            s = r.choice(["Mc", "O'", "Mac"]) + s
        if r.random() < 0.12:
            s += "-" + self.invented()
        x = r.random()
        return r.choice(PARTICLES) + " " + s if x < 0.06 else "d'" + s if x < 0.08 else s

    def name(self) -> str:
        r = self.r
        # Some given names are in no list.
        listed = r.random() < 0.6
        g, s = r.choice(self.given).capitalize() if listed else self.rare(), self.surname()
        x = r.random()
        if x < 0.14:
            g, listed = g[0] + ".", True
        elif x < 0.24:
            g += " " + r.choice("ABCDEFGHIJKLMNOPRSTVW") + "."
        elif x < 0.32:
            g += " " + r.choice(self.given).capitalize()
        n = f"{s}, {g}" if r.random() < 0.15 else f"{g} {s}"
        y = r.random()
        return n.upper() if y < 0.06 else n.lower() if listed and y < 0.1 else n

    def phone(self) -> str:
        r, d = self.r, self.digits
        kinds = [
            "01999 999999", "01999 999 999", "020 9999 9999", "07999 999999", "07999 999 999", "+44 9999 999999", "+44 9999 999 999", "+44 (0)9999 999 999", "+44 20 9999 9999", "00 44 9999 999 999",
            "(999) 999-9999", "999-999-9999", "9999999999", "9999999999", "+1 (999) 999 9999", "+1 999 999 9999", "+1-999-999-9999", "1-999-999-9999 ext. 99", "999 999 9999", "999.999.9999", "999/999-9999", "9999999999", "+1.999.999.9999", "+1 999-999-9999", "(999) 999 9999 x 999",
            "030 99999 999", "030 9999999", "099/99999999", "(099) 99999-999", "+49 99 99999-999", "+49 99 99999 999", "+49 (0)99 9999999", "0049 99 99999999", "0199 9999999", "01999 99999-99",
            "+33 9 99 99 99 99", "+33 (0)9 99 99 99 99", "09 99 99 99 99", "09-99-99-99-99", "09.99.99.99.99", "0699999999", "+34 999 999 999", "+34 999 99 99 99", "699 999 999", "+41 99 999 99 99",
        ]
        s = "".join(d(1) if c == "9" else c for c in r.choice(self.kept(kinds) if self.part is False else kinds))
        if r.random() < 0.05:
            s = s.replace("-", "‑")
        return s.replace(" ", " ") if r.random() < 0.04 else s

    def id_number(self) -> str:
        r = self.r
        kinds = ["999-99-9999", "999 99 9999", "999.99.9999", "999999999", "AA999999A", "AA 99 99 99 A", "A9999999", "A99999999", "AA9999999", "99999999A", "99999999-A", "99.999.999-A", "X9999999A", "Y9999999-A", "99 999 999 999", "99999999999", "1 99 99 99 999 999 99", "2 99 99 99 999 999 99", "299999999999999", "199999999999999"]
        s = self.filled("#" + r.choice(kinds))[1:]
        return s.lower() if r.random() < 0.08 else s

    def email(self, person: str | None = None) -> str:
        """An address, of a person where one is given (given name, family name)."""
        r = self.r
        g, s = r.choice(self.given), self.invented().lower()
        if person:
            words = [w for w in person.lower().replace(",", "").replace("'", "").split(" ") if len(w) > 3]
            s = "".join(c for c in unicodedata.normalize("NFKD", words[0 if "," in person else -1].split("-")[0]) if c.isalpha()) if words else s
        local = r.choice([f"{g}.{s}", f"{g}_{s}", f"{g[0]}{s}{self.digits(2)}", f"{s}-{g[0]}", f"{g}+{r.choice(['news', 'shop', 'list'])}", f"{g}{r.randint(1950, 2009)}", s])
        full = f"{r.choice(DOMAINS)}.{r.choice(TLDS)}"
        x = r.random()
        at, dot = ("@", ".") if x < 0.7 else r.choice([(" [at] ", " [dot] "), ("(at)", "."), (" AT ", " DOT "), (" (at) ", " (dot) "), (" arroba ", " punto "), ("(arobase)", "(point)"), (" @ ", ".")])
        e = local + at + full.replace(".", dot)
        return e.upper() if r.random() < 0.05 else e

    def street(self) -> str:
        r = self.r
        n = str(r.randint(1, r.choice([9, 99, 999, 1999]))) + (r.choice("abcd") if r.random() < 0.12 else "")
        language = r.choice(self.languages)
        names, kinds = STREETS[language]
        name, kind = r.choice(self.kept(names)), r.choice(kinds)
        if language == "en":
            s = f"{n} {r.choice(['', '', '', 'N. ', 'S ', 'East ', 'Lower ', 'New '])}{name} {kind}"
            x = r.random()
            return s.upper() if x < 0.08 else s.lower() if x < 0.16 else s
        if language == "de":
            return f"{r.choice(['Am', 'Im', 'Zum'])} {r.choice(['', 'Neuen ', 'Langen '])}{name}{r.choice(['berg', 'hof', 'grund'])} {n}" if r.random() < 0.15 else f"{name}{kind} {n}"
        if language == "fr":
            return f"{n}{r.choice(['', ' bis', ' ter'])}{r.choice([',', ''])} {kind} {name}"
        return f"{kind} {name}{r.choice([', nº', ',', ''])} {n}"

    def thing(self) -> str:
        """A sentence with the number of a thing."""
        r = self.r
        language = r.choice(self.languages)
        s, t = r.choice(THING_FRAMES[language]), r.choice(self.kept(THINGS[language]))
        s = s.replace("{T}", t[:1].upper() + t[1:]).replace("{t}", t)
        while "{n}" in s:
            s = s.replace("{n}", self.id_number() if r.random() < 0.35 else self.filled(r.choice(THING_NUMBERS)), 1)  # things are numbered like persons, too
        return s

    def code(self) -> str:
        """A sentence with a code name or, in German, with nouns."""
        r = self.r
        language = r.choice(self.languages)
        if language == "de" and r.random() < 0.7:
            article = lambda: r.choice(["der", "das", "die"])
            s = f"{article()} {r.choice(NOUNS_DE)} den {r.choice(NOUNS_DE)}"
            return r.choice([s.capitalize().replace(s[4:], s[4:]) + ".", f"Am Montag {r.choice(VERBS_DE)} {s}.", f"{article().capitalize()} {r.choice(NOUNS_DE)} {r.choice(VERBS_DE)} den {r.choice(NOUNS_DE)} der {r.choice(NOUNS_DE)}."])
        pattern, a, b, frames = CODES[language]
        name = lambda: pattern.format(a=r.choice(a), a2=r.choice(a).lower(), b=r.choice(b))
        return r.choice(frames).format(c=name(), c2=name())

    def plain(self) -> str:
        return self.one_of(PLAIN) + "."

    def document(self) -> tuple[str, list[tuple[int, int, str]]]:
        """(text, [(start, end, type)])."""
        r = self.r
        text, spans = [], []
        size = 0

        def put(s: str, kind: str | None = None) -> None:
            nonlocal size
            if kind:
                spans.append((size, size + len(s), kind))
            text.append(s)
            size += len(s)

        held: dict[str, list[str]] = {}

        def again(kind: str, make) -> str:
            """A new value or one of this text again."""
            mine = held.setdefault(kind, [])
            if mine and r.random() < 0.3:
                return r.choice(mine)
            mine.append(make())
            return mine[-1]

        def mail() -> str:
            return again("email", lambda: self.email(r.choice(known) if known and r.random() < 0.5 else None))

        def framed(frames: dict[str, list[str]], value: str, kind: str) -> None:
            before, after = self.one_of(frames).split("{}")
            put(before)
            put(value, kind)
            put(after)

        known: list[str] = []

        def person() -> str:
            """A new name, or one of this text again, perhaps by an initial."""
            if not known or r.random() < 0.6:
                known.append(self.name())
                return known[-1]
            n = r.choice(known)
            words = n.split(" ")
            return f"{words[0][0]}. {' '.join(words[1:])}" if "," not in n and n[0].isupper() and len(words) == 2 and r.random() < 0.3 else n

        for _ in range(r.randint(3, 12)):
            x = r.random()
            if x < 0.14:
                put(self.plain())
            elif x < 0.2:
                put(again("code", self.code))
            elif x < 0.27:
                put(self.one_of(NOT_NAMES).replace("{P}", self.invented()))
            elif x < 0.43:
                put(again("thing", self.thing))
            elif x < 0.48:
                put(self.filled(r.choice(OTHER_NUMBERS)))
            elif x < 0.51:
                put(self.filled(r.choice(NOT_MAIL)))
            elif x < 0.63:
                framed(NAME_FRAMES, person(), "person_name")
            elif x < 0.69:
                framed(PHONE_FRAMES, again("phone", self.phone), "phone")
            elif x < 0.78:
                framed(ID_FRAMES, again("id", self.id_number), "id_number")
            elif x < 0.83:
                framed(MAIL_FRAMES, mail(), "email")
            elif x < 0.89:
                framed(STREET_FRAMES, again("street", self.street), "street_address")
            elif x < 0.95:  # a block
                put(r.choice(OPENINGS))
                sep = r.choice([", ", "\n", ";", " | ", " / "])
                put(person(), "person_name")
                for kind in r.sample(["phone", "id_number", "street_address", "email"], r.randint(1, 3)):
                    put(sep)
                    if kind == "phone":
                        put(r.choice(["", "tel ", "phone: "]))
                        put(again("phone", self.phone), kind)
                    elif kind == "id_number":
                        put(r.choice(["", "ID "]))
                        put(again("id", self.id_number), kind)
                    else:
                        put(again("street", self.street) if kind == "street_address" else mail(), kind)
            else:
                put(self.filled(r.choice(NOT_STREETS)))
            put(r.choice([" ", " ", "\n", "\n\n"]))
        return "".join(text), spans
