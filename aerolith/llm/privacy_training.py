"""Sentences with labelled personal information, composed from general phrases of letters, minutes, mails and reports in several languages.

A frame is a phrase with slots; slots are filled by grammars of names, addresses, numbers and emails, or by look-alikes that are no personal information (streets and
schools named after someone, companies, headings, models, serial numbers, dates, handles). Families, towns and streets are common ones or put together from syllables. In a
part of the sentences the plain words give way to made-up ones, so that a segment is judged by its own form and not by known neighbours alone.
No text of any data set went into this file.
"""

from __future__ import annotations

import random
import re

from .privacy import _DNI_LETTERS, GIVEN

FAMILIES = (
    "Martin Bernard Dubois Thomas Robert Richard Petit Durand Leroy Moreau Simon Laurent Lefebvre Michel Garcia Bertrand Roux Vincent Fournier Morel Girard Mercier Dupont Lambert Bonnet Fontaine Rousseau "
    "Blanc Guerin Boyer Garnier Chevalier Legrand Gauthier Perrin Robin Clement Morin Nicolas Henry Roussel Mathieu Gautier Masson Marchand Duval Denis Dumont Lemaire Noel Meyer Dufour Meunier Brun Blanchard "
    "Giraud Joly Riviere Lucas Brunet Gaillard Barbier Arnaud Renard Schmitt Roy Leroux Colin Vidal Caron Picard Roger Fabre Aubert Lemoine Renaud Dumas Smith Jones Taylor Brown Williams Wilson Johnson Davies "
    "Evans Wright Walker White Green Hall Wood Harris Clarke Turner Hill Cooper Ward Morris Moore King Baker Harrison Morgan Allen Scott Edwards Parker Müller Schmidt Schneider Fischer Weber Wagner Becker "
    "Schulz Hoffmann Koch Bauer Richter Klein Wolf Schröder Neumann Schwarz Zimmermann Braun Krüger Hartmann González Rodríguez Fernández López Martínez Sánchez Pérez Gómez Ruiz Hernández Jiménez Díaz Moreno "
    "Muñoz Álvarez Romero Alonso Gutiérrez Navarro Torres Rossi Russo Ferrari Esposito Bianchi Romano Colombo Ricci Marino Silva Santos Ferreira Pereira Costa Novak Kowalski Nguyen Okafor Haddad Larsen O'Brien"
).split()
_HEAD = "Ab Al Ar Bal Bel Ber Bor Bran Cal Cam Car Cas Cha Cla Cor Dal Dar Del Des Dor Du El Er Fa Fer Fla For Fra Gal Gar Ger Gon Gra Gre Hal Har Hel Her Hol Is Jar Kar Kel Kor La Lan Lar Le Lor Lu Mal Mar Mel Mer Mo Mon Nar Nor Ol Or Pal Par Pel Per Pra Qui Ral Ram Ren Ri Ro Sal San Sar Sel Ser Sol Ta Tal Tar Ter Tor Tra Val Var Vel Ver Vil Wal Wer Zan".split()
_MIDDLE = "a ba be bi bo ca de di do fa fe ga gi go la le li lo ma me mi mo na ne ni no ra re ri ro sa se ta te ti va vi".split()
_TAIL = "ac ain and ard as at aud ault aux bach beck berg bert by cour dal den dez don eau el ell er ery es et ette ez feld field ford gard gren hart ian ic ier in ini ins is itz ka ker land ley lin man mann mont nard ner net nier not o on ot quin ran rez rin ro sen ski son stein teau ter tin ton trand us vic ville vin well wick y zak".split()
_TOWN_TAIL = "ac bourg burg court dorf ford ham haven heim hofen ignac igny lac mont mouth nay olles pont stadt tal ton val vale vaux ville wick y".split()
_STREET_FR = "de la Gare;des Lilas;du Moulin;de l'Église;des Acacias;Victor Hugo;Jean Jaurès;Pasteur;du Port;de Verdun;des Écoles;de la République;du Château;Gambetta;Émile Zola;du 8 mai;de Strasbourg;Saint-Michel;des Tilleuls;d'Alsace;aux Fleurs;Voltaire".split(";")
_STREET_DE = "Bahnhofstraße;Hauptstr.;Gartenweg;Lindenallee;Schillerplatz;Mozartstraße;Am Markt;Im Winkel;Zum Bach;Kirchgasse;Rosenweg;Goethestraße;Uferstr.;An der Mühle;Auf dem Berg;Schulstraße;Wiesenweg".split(";")
_STREET_ES = "Calle Mayor;Avenida de la Constitución;C/ San Juan;Plaza de España;Paseo del Prado;Calle de Alcalá;Camino Real;Via Roma;Viale Europa;Rua do Sol;Calle Nueva;Piazza Dante".split(";")
_STREET_EN = "High Street;Church Lane;Station Road;Park Avenue;Mill Road;Oak Drive;Queen Street;Victoria Road;Elm Close;Maple Court;Green Lane;River Terrace;Chestnut Grove;Bridge St;Main Street;London Rd;Castle Hill;Abbey Gardens;St. John Street;Kings Way".split(";")
_COMMON = "Annual Report;Weather Station;Solar Panel;Heat Pump;Project Plan;Open Data;New York;Great Britain;Rapport Annuel;Plan Climat;Union Européenne;Grand Est;Île De France;Conseil Régional;Haute Savoie;Banco Central;Plan General;Informe Final;Buenos Aires;Technischer Bericht;Neue Messung;Deutsche Bahn;Stadt Köln;Europäische Union;Wichtiger Hinweis;North Sea;South East;Quality Control;Change Log;Read Me;User Guide;Phase Two;Mont Blanc;Val Thorens;Côte Ouest;Mer Du Nord;Black Forest;Air Quality;Data Center;Energy Audit;Audit Énergétique;Bilan Carbone;Datos Abiertos;Red Eléctrica;Section Two;Table One;Monday Morning;Lundi Matin;Anno Domini;World Bank;United Nations;Red Cross".split(";")
_PLACE_FR = "rue;avenue;place;école;collège;lycée;salle;square;gymnase;stade;parc;pont;boulevard;résidence;groupe scolaire;médiathèque;théâtre;hôpital;quai;allée;jardin;halle;centre;station;école maternelle;salle polyvalente;tour;capteur;sonde;impasse;chemin".split(";")
_PLACE_EN = "School;Street;Hall;Square;Park;Bridge;Road;College;Library;House;Hospital;Institute;Avenue;Gardens;Museum;Centre;Airport;Station;Lane;Academy;sensor;Field;Tower".split(";")
_PLACE_DE = "-Schule;-Platz;-Straße;-Halle;-Gymnasium;-Brücke;-Allee;-Saal;-Haus;-Institut;-Sensor;-Weg;-Stiftung".split(";")
_PLACE_ES = "calle;plaza;avenida;colegio;instituto;parque;puente;escuela;hospital;paseo;biblioteca;teatro;via;piazza;scuola;rua;escola;estación;barrio;sala".split(";")

#: Slots: N name, T title and name, S family name alone (no case), A address, P phone, I identity number, E email, W town, D digits, U number of another kind, L capitalised words, K place named
#: after someone, M instrument or product, H handle, R a made-up word, C a company, Q an abbreviation, B a noun with a capital.
FRAMES = (
    # who acts, is asked, thanked, named
    "{N} a appelé hier.", "{N} est passé ce matin pour la clé.", "Signé : {N}", "Rédigé par {N}", "Compte rendu de {N}, le 3 mai.", "Relecture : {N}.", "Merci à {N} pour son aide.", "Merci {N} !", "Bonjour {N}, merci de votre retour.", "Bonjour {T},",
    "Cher {T}, veuillez trouver la facture.", "Contact : {N}", "Contact : {N}, tél. {P}", "Je remercie {T} pour sa visite.", "D'après {N}, tout va bien.", "selon {N} et {N}, rien à signaler", "Présents : {N}, {N}, {N}.", "Présents : {N}, {T} et {N}", "Absents excusés : {N} ; {N}",
    "Le dossier a été transmis à {N} par courrier.", "{T} a demandé un devis.", "Voir avec {N} avant vendredi.", "Photo : {N}.", "Auteur : {N}", "Opérateur : {N}", "Responsable : {N}", "Visite avec {N} à 9 h.", "J'ai rencontré {N}, qui habite ici.", "la voisine, {T}, se plaint du bruit",
    "{N} propose une date.", "{N} et {N} ont signé.", "Le rapport de {N} est arrivé.", "Demandez à {N}.", "Je soussigné {N} atteste ceci.", "Bien à vous,\n{N}", "Cordialement,\n{N}", "Cordialement, {N}", "-- \n{N}\n", "{N} (gardien) a ouvert la porte.", "Technicien {N} sur place.", "intervention de {N}",
    "{N} called yesterday.", "Written by {N}", "Reported by {N}.", "Thanks to {N} for the help.", "Thanks {N}!", "Thank you, {N}.", "Dear {T},", "Dear {N},", "Hello {N}, see below.", "Hi {N},", "Contact {N} for details.", "Contact: {N}, phone {P}", "According to {N}, it works.", "Attendees: {N}, {N} and {N}.",
    "I met {T} last week.", "{T} asked for a quote.", "Please ask {N} first.", "The keys are with {N}.", "{N} and {N} agreed.", "Checked by {N} on Monday.", "Best regards,\n{N}", "Regards, {N}", "Yours sincerely,\n{N}\n", "Author: {N}", "Operator: {N}", "observer {N}", "{N} (caretaker) let us in.", "my neighbour {N} said so",
    "{N} will call back.", "the owner, {N}, refused", "{N} replaced the filter.", "Visit with {N} at noon.", "signed {N}", "as {N} wrote:", "{N} wrote:", "Speaker: {N} (city council)", "reviewed by {T}", "{T} was informed.", "We spoke to {N} about it.", "{N} noted a leak.",
    "{N} hat angerufen.", "Bericht: {N}", "Verfasst von {N}", "Gemeldet von {N}.", "Danke an {N} für die Hilfe.", "Danke {N}!", "Sehr geehrte {T},", "Sehr geehrter {T},", "Liebe {N},", "Hallo {N}, bitte melden.", "Ansprechpartner: {N}, Tel. {P}", "Laut {N} ist alles gut.", "Teilnehmer: {N}, {N} und {N}.", "{T} wohnt im Haus.",
    "Bitte {N} fragen.", "Der Schlüssel liegt bei {N}.", "{N} und {N} haben zugestimmt.", "Geprüft von {N}.", "Mit freundlichen Grüßen\n{N}", "Viele Grüße, {N}", "Herr Kollege {N} kommt später.", "unser Nachbar {N} klagt", "{T} hat gefragt.", "Beobachter: {N}",
    "{N} llamó ayer.", "Firmado: {N}", "Redactado por {N}", "Informe de {N}.", "Gracias a {N} por la ayuda.", "Gracias {N}!", "Estimado {T}:", "Estimada {N}, adjunto el plano.", "Hola {N}, buenas tardes.", "Contacto: {N}, tel. {P}", "Según {N}, todo va bien.", "Asistentes: {N}, {N} y {N}.", "{T} pidió un presupuesto.",
    "Pregunte a {N}.", "La llave la tiene {N}.", "{N} y {N} firmaron.", "Revisado por {N}.", "Saludos,\n{N}", "Atentamente, {N}", "el vecino {N} protesta", "{T} no estaba.", "{N} ha chiamato ieri.", "Grazie a {N}.", "Scritto da {N}", "Gentile {T},", "Obrigado a {N}.", "Escrito por {N}",
    "Nom : {N}", "Name: {N}", "Nombre: {N}", "Nom : {N}\nAdresse : {A}\nTél. : {P}\n", "{N}\n{A}\n{P}\n{E}", "{N} <{E}>", "{N} ({E})", "{N}, {A}", "{N} - {P}", "{N} / {P} / {E}", "{N}; {I}", "From: {N} <{E}>", "De : {N} <{E}>", "{N}, né le 12/03/1975, {I}", "{N}, {P}", "M. et Mme {F} sont partis.", "{R} {N} {R}.", "{R} {R} {N}", "{N} {R} {R} {R}.",
    "{R}, {N}, {R}", "{R}: {N}", "({N})", "{R} {T} {R}", "{T} {R} {R}.", "- {N}\n- {N}\n- {N}\n", "{R} {N} {K}", "{N} {R} {R} {K}.", "{N} {R} {M} {R}",
    "Maintenance : {N}", "maintenance effectuée par {N}", "filtre changé par {N} le 12", "{N} a nettoyé l'entonnoir.", "batterie remplacée ({N})", "relève faite avec {N}", "opération confiée à {N}, technicien", "sensor swapped by {N}", "{N} cleaned the funnel.", "fault logged by {N} at 6 am", "battery changed ({N})", "Wartung durch {N}",
    "{N} hat den Filter getauscht.", "mantenimiento a cargo de {N}", "{N} limpió el embudo.", "# author: {N}", "# {N}, 2021", "// written by {N}", "TODO({N}): tidy up", "maintainer = {N}", "Reviewed-by: {N} <{E}>", "Salut {N}, as-tu essayé ?", "@{N} merci", "comme le dit {N} plus haut", "as {N} said above", "wie {N} oben schreibt", "como dice {N}",
    "propriétaire : {N}", "locataire : {N}, {A}", "diagnostic établi par {N}", "audit conducted by {N}", "owner: {N}", "tenant {N} reports damp", "Eigentümer: {N}", "Mieterin {N} meldet Schimmel", "propietario: {N}", "Enquêtrice : {N}", "questionnaire rempli par {N}", "interviewed {N} at home", "interviewer: {N}", "respondent {N}", "Befragt wurde {N}.", "encuestador: {N}",
    "Sont venus {N}, puis {N}.", "Étude dirigée par {N}, thésard", "chef de projet {N}", "l'architecte {N} valide le plan", "the engineer {N} signed off", "project lead {N}", "Ingenieur {N} prüft", "la arquitecta {N} firma", "mail de {N} reçu", "email from {N}", "{N} habite à côté.", "{N} lives next door.", "{N} signale une panne.", "{N} wants a copy.",
    "{N} confirme.", "{N} confirms.", "{N} bestätigt.", "{N} confirma.", "pour {N}", "for {N}", "für {N}", "para {N}", "de {N}", "von {N}", "with {N}", "mit {N}", "con {N}", "et {N}", "and {N}", "und {N}",
    "Avec {N} {R}.", "Chez {N} tout va bien.", "Pour {N}", "Par {N}", "By {N}", "Von {N}", "Mit {N} {R}.", "Por {N}", "Con {N} {R}.", "Selon {N}, {R}", "Observateur {N}", "Technicienne {N}", "Observer {N}", "Engineer {N} {R}", "Techniker {N} {R}.", "Kollegin {N} {R}.", "Nachbar {N} {R}", "Vecina {N} {R}", "Ingeniero {N}", "Voisin {N} : {R}", "Today {N} {R}.",
    "Hier {N} {R}.", "Gestern {N} {R}.", "Ayer {N} {R}.", "Ensuite {N} {R}", "Then {N} {R}", "Dann {N} {R}", "Puis {N} {R}", "{B} {N} {R}.", "Der {B} {N} {R}.", "Die {B} {N}",
    # addresses
    "Adresse : {A}", "habite au {A}", "J'habite {A}.", "Livraison au {A} avant midi.", "Rendez-vous {A} à 10 h.", "address: {A}", "She lives at {A}.", "Send it to {A}, please.", "Meet at {A} at noon.", "Deliver to {A}.", "Anschrift: {A}", "Er wohnt {A}.", "Lieferung an {A}.", "wohnhaft {A}", "Dirección: {A}", "Vive en {A}.", "Entrega en {A}.",
    "domicilio en {A}", "chez {N}, {A}", "{A}", "{A}\n", "{R} {R} {A}.", "le logement du {A} est froid", "the flat at {A} is cold", "the house ({A})", "Wohnung {A}, dritter Stock", "siège : {A}", "au {A}, deuxième étage",
    # phones
    "Tél. {P}", "Tel: {P}", "téléphone {P}", "Appelez le {P}.", "Appeler {N} au {P}", "au {P} après 18 h", "Joindre au {P} ou {E}", "mobile {P}", "portable : {P}", "fax {P}", "Call {P} before five.", "phone: {P}", "ring {N} on {P}", "Reach me at {P}.", "text {P}", "Telefon {P}", "Rufen Sie {P} an.", "Handy: {P}", "erreichbar unter {P}", "Teléfono: {P}",
    "Llame al {P}.", "móvil {P}", "WhatsApp {P}", "{P}", "{R} {P} {R}", "urgence : {P}", "my number is {P}", "rappeler au {P}", "numéro {P}",
    # identity numbers
    "NIR {I}", "N° de sécurité sociale : {I}", "sécu {I}", "numéro fiscal {I}", "Social security number {I}", "SSN: {I}", "SSN {I}", "NINO {I}", "National Insurance {I}", "NI number: {I}", "DNI {I}", "con DNI {I}", "NIE {I}", "NIF: {I}", "Steuer-ID {I}", "Steuernummer: {I}", "Identifikationsnummer {I}", "tax id {I}", "codice fiscale {I}", "{I}",
    "identité : {I}", "{R} {I}", "id number {I} on file", "assuré {I}", "titular {N}, DNI {I}", "{N} ({I})",
    # emails
    "{E}", "mail : {E}", "Écrire à {E}.", "courriel {E}", "Email: {E}", "write to {E}", "Send the file to {E}.", "Mail an {E}", "E-Mail: {E}", "Correo: {E}", "Escriba a {E}.", "contact {E} ou {P}", "répondre à {E} merci", "{R} {E} {R}", "cc {E}, {E}", "<{E}>", "({E})",
    # none of these
    "Le {Q} {R} {R}.", "La {Q} {R}.", "The {Q} {R} {R}.", "Der {Q} {R}.", "Das {Q} {R}", "El {Q} {R}.", "Il {Q} {R}", "Les {Q} {R}", "Un {Q} {R}.", "Die {Q} {R} {R}", "Ce {Q} {R}", "This {Q} {R}", "{B} {Q} {R} {R}.", "{W} {Q} {R}.", "Le {B} {R}.", "The {B} {R}.", "Der {B} {R}.", "Le {B} {S} {R}.", "{R}. {B} {Q} {R}.",
    "{Q} de {W} : rien", "le {Q} de {W}", "la {Q} du {W}", "{Q} {W}", "{W} {Q}", "au {B} de {W}, {R}", "le {B} du {S} est neuf", "{B} de {W}", "{B} {Q}", "{Q} {B}", "the {Q} of {W}", "from {Q} {W}", "das {Q} {W}", "der {B} von {W}", "{B} von {W}", "la {B} de {S}", "el {B} de {W}",
    "{Q} de {W} et {Q} de {W}", "avec {Q} {S}", "{R} {Q} de {S} {R}", "{R} {B} de {W} {R}.", "{R} {B} {B} {R}", "{W} de {W}", "{R} {W} {Q} {R}", "{Q} {B} {W}", "{R} {B} {W}.", "carte {Q} de {W}", "{Q} and {Q}", "{B} und {B}", "{R} {Q} {R}",
    "{R} {K} {R}.", "vers {K}", "{K} : 31 degrés", "à 20 m de {K}", "from {K} to {K}", "from {K}, turn left", "in der Nähe: {K}", "{K}, {W}", "{K} ({W})", "le toit de {K}", "relevés de {K} et {K}, puis {K}", "{K} shows 4 degrees", "- {K}\n- {K}\n", "arbres de {K}", "{K} messen", "hacia {K}",
    "{K} est fermé.", "Près de {K}, il fait chaud.", "devant {K}", "Mesure à {K}.", "travaux {K} et {K}", "{K}", "rénovation de {K} en 2019", "The {K} is closed.", "near {K}", "at {K} today", "Der {K} ist zu.", "bei {K}", "cerca de {K}", "en {K}", "{L}", "# {L}", "## {L}\n", "{L} :", "Le {L} est publié.", "The {L} is out.", "Das {L} ist da.",
    "El {L} ya está.", "{L} et {L}", "see {L}, section 3", "{C} a livré le matériel.", "{C} delivered it.", "contrat avec {C}", "by {C}", "par {C}", "{M} installé hier", "the {M} was calibrated", "{M}", "Gerät {M} geprüft", "nouveau {M} sur le toit", "{R} {L} {R}", "{R} {M}", "{R} {K}", "{L} {R} {R}.", "{W} et {W} sont jumelées.", "from {W} to {W}", "zwischen {W} und {W}",
    "Mairie de {W}", "{W}, le 4 juin", "Prévisions pour {W} et {W}", "ref {U}", "n° {U}", "commande {U}", "SIRET {U}", "série {U}", "lot {U}", "order {U}", "ticket {U}", "invoice no. {U}", "Rechnung {U}", "pedido {U}", "id {U}", "code {U}", "ISBN {U}", "version {U}", "{U}", "{U} {U} {U}", "valeurs {U}", "le {U}", "serial {U}", "IP {U}",
    "coordonnées {U}", "parcel {U}", "{R} {U}", "total {U} kWh", "compteur {U}", "{U};{U};{U}", "Zählerstand {U}", "{H} a répondu", "merci {H}", "thanks {H}", "@{H}", "posted by {H}", "{H}: ok", "image {H}@2x.png", "{R}@2x.png", "x@0.5.txt", "p@5s.dat", "k@7m.nc", "{R} q@3h.csv {R}", "git clone git@host:{R}/{R}.git", "3 points @ 4 m", "matrix a@b is singular", "meet at noon at the station", "look at example. com is down",
    "12 places de parking", "20 rue(s) concernées", "rue de la Gare barrée", "Main Street is closed", "Bahnhofstraße gesperrt", "2 m de la route nationale", "3 Street trees per block", "between 5 and 7 trees", "pont de {W}", "ligne 12 place de la gare", "Saint {S} reste calme", "{S} est une marque", "vent {S} fort", "le 12 avenue prochaine", "5 court meetings",
    "Bonjour Monsieur,", "Dear Sir,", "Sehr geehrte Damen und Herren,", "Chère Madame,", "Bonjour à tous", "Hello World", "Hi All,", "Merci Beaucoup", "Bonne Année", "Good Morning", "Guten Tag", "Buenos Días", "Vielen Dank", "Mr President", "Monsieur le Maire", "Madame la Présidente", "{L}. {L}.", "Le {R} {R}. La {R}.", "In {R} Der {R}", "Il {R}. Elle {R}. On {R}.",
)
_KIND = {"N": "name", "T": "name", "F": "name", "A": "address", "P": "phone", "I": "id_number", "E": "email"}
_SLOT = re.compile(r"\{([A-Z])\}")
_givens = sorted(GIVEN)
_ACCENTS = {"adele": "adèle", "amelie": "amélie", "andre": "andré", "beatrice": "béatrice", "cecile": "cécile", "francois": "françois", "helene": "hélène", "jose": "josé", "jurgen": "jürgen", "gunter": "günter", "irene": "irène", "monica": "mónica"}


def _pick(r: random.Random, words: list[str] | tuple) -> str:
    return words[r.randrange(len(words))]


def _built(r: random.Random, tails: list[str]) -> str:
    return _pick(r, _HEAD) + (_pick(r, _MIDDLE) if r.random() < 0.35 else "") + _pick(r, tails)


def family(r: random.Random) -> str:
    name = _pick(r, FAMILIES) if r.random() < 0.3 else _built(r, _TAIL)
    if r.random() < 0.05:
        name += "-" + _built(r, _TAIL)
    return name


def given(r: random.Random) -> str:
    """Mostly a known first name; some are made up, as no list has all."""
    x = r.random()
    if x < 0.6:
        g = _pick(r, _givens)
        g = _ACCENTS.get(g, g).title()
    else:
        g = _built(r, "a ane aud bert dan delle e ea el elle en eo ert ette ia ian ic ie iel ien ik ina ine io is ita lia lin lo na nand nie o ol on or rick s sa so tan ton us vin y ya".split())
    return f"{g}-{_pick(r, _givens).title()}" if r.random() < 0.07 else g


def person(r: random.Random) -> str:
    f, g = family(r), given(r)
    if r.random() < 0.12:
        f = _pick(r, ["de ", "de la ", "du ", "von ", "van ", "van der ", "del ", "di ", "Le ", "La ", "da ", "Mac ", "Ní "]) + f
    elif r.random() < 0.05:
        f = f"{f} {family(r)}"
    if r.random() < 0.2:
        f = f.upper()
    if r.random() < 0.12:
        g = g[0] + "." + (f" {_pick(r, 'ABCDEFGHJKLPRST')}." if r.random() < 0.1 else "")
        g = g.replace("M.", "N.") if g == "M." else g
    elif r.random() < 0.04:
        g = f"{g} {_pick(r, 'ABCDEFGHJKLPRST')}."
    x = r.random()
    return f"{f} {g}" if x < 0.16 else f"{f}, {g}" if x < 0.22 else f"{g} {f}"


def titled(r: random.Random) -> tuple[str, str]:
    t = _pick(r, "Mme;M.;Mlle;Mr;Mrs;Ms;Dr;Dr.;Mr.;Mrs.;Herr;Frau;Sr.;Sra.;Srta.;Don;Doña;Monsieur;Madame;monsieur;madame;señor;señora;Señor;Professeur;Prof.;Signora;Miss;M.;Mme".split(";"))
    f = family(r)
    if r.random() < 0.08:
        f = _pick(r, ["de ", "de la ", "du ", "von ", "van "]) + f
    if r.random() < 0.15:
        f = f.upper()
    return t + " ", f"{given(r)} {f}" if r.random() < 0.25 else f


def town(r: random.Random) -> str:
    t = _built(r, _TOWN_TAIL)
    x = r.random()
    return f"Saint-{t}" if x < 0.08 else f"{t}-{_pick(r, ['sur', 'les', 'le', 'en', 'la'])}-{_built(r, _TOWN_TAIL)}" if x < 0.16 else f"{t}-{_pick(r, ['Sur', 'Les', 'Le'])}-{_built(r, _TOWN_TAIL)}" if x < 0.2 else t


def address(r: random.Random) -> str:
    n = str(r.choice([r.randint(1, 9), r.randint(10, 99), r.randint(100, 250)]))
    mark = _pick(r, [" bis", "bis", " ter", "ter", "B", " A", "a"]) if r.random() < 0.12 else ""
    post, place = f"{r.randint(1000, 98999):05d}", town(r)
    who = f"{given(r)} {family(r)}" if r.random() < 0.5 else family(r)
    form = r.randrange(4)
    if form == 0:
        kind = _pick(r, "rue avenue place boulevard impasse chemin quai allée route bd av. cours sentier".split())
        name = _pick(r, _STREET_FR) if r.random() < 0.5 else who if r.random() < 0.6 else f"{_pick(r, ['de ', 'du ', 'des ', 'de la '])}{_built(r, _TAIL)}"
        if r.random() < 0.1:
            kind = kind.title()
        street, tail = f"{n}{mark}{',' if r.random() < 0.25 else ''} {kind} {name}", f"{post} {place}"
        if r.random() < 0.08:
            street, tail = street.upper(), tail.upper()
    elif form == 1:
        name = _pick(r, _STREET_DE) if r.random() < 0.5 else _built(r, _TAIL) + _pick(r, "straße str. weg gasse platz allee".split())
        street, tail = f"{name} {n}{'a' if r.random() < 0.1 else ''}", f"{post} {place}"
    elif form == 2:
        name = _pick(r, _STREET_ES) if r.random() < 0.6 else f"{_pick(r, ['Calle', 'Avenida', 'Plaza', 'C/', 'calle', 'Via', 'Paseo'])} {_pick(r, ['', '', 'de ', 'del '])}{_built(r, _TAIL)}"
        street, tail = f"{name}{_pick(r, [' ', ', ', ', nº ', ' nº '])}{n}", f"{post} {place}"
    else:
        name = _pick(r, _STREET_EN) if r.random() < 0.5 else f"{_built(r, _TAIL)} {_pick(r, 'Street Road Lane Avenue Close Drive Way Court Grove Terrace St Rd'.split())}"
        street = f"{n}{'A' if r.random() < 0.08 else ''} {name}"
        uk = f"{_pick(r, ['SW', 'N', 'B', 'LS', 'EC', 'M', 'BS'])}{r.randint(1, 20)} {r.randint(1, 9)}{_pick(r, 'ABDEFGHJ')}{_pick(r, 'ABDEFGHJ')}"
        us = f"{_pick(r, ['NY', 'CA', 'TX', 'OH', 'MA'])} {r.randint(10000, 99999)}"
        return street if r.random() < 0.35 else f"{street}, {place}" + ("" if r.random() < 0.35 else f"{_pick(r, [', ', ' '])}{uk}" if r.random() < 0.6 else f", {us}")
    return street if r.random() < 0.35 else street + _pick(r, [", ", " ", ", ", "\n", " - ", ",\n"]) + tail


def _digits(r: random.Random, n: int) -> str:
    return "".join(r.choice("0123456789") for _ in range(n))


def _grouped(digits: str, sizes: list[int], sep: str) -> str:
    out, at = [], 0
    for n in sizes:
        out.append(digits[at : at + n])
        at += n
    return sep.join(out)


def phone(r: random.Random) -> str:
    d, sep = _digits(r, 12), _pick(r, [" ", " ", ".", "-", "", " "])
    x = r.randrange(12)
    if x < 4:
        return _grouped("0" + _pick(r, "123456679") + d[:8], [2] * 5, sep)
    if x == 4:
        lead = _pick(r, ["+33", "0033", "+33"])
        return f"{lead}{sep}{_pick(r, ['', '', '(0)' + sep])}" + _grouped(_pick(r, "1234567") + d[:8], [1, 2, 2, 2, 2], sep)
    if x == 5:
        return _pick(r, [f"07{d[:3]} {d[3:9]}", f"07{d[:3]} {d[3:6]} {d[6:9]}", f"020 7{d[:3]} {d[3:7]}", f"0121 {d[:3]} {d[3:7]}", f"01{d[:3]} {d[3:9]}", f"(020) 7{d[:3]} {d[3:7]}", f"07{d[:9]}"])
    if x == 6:
        return _pick(r, [f"+44 7{d[:3]} {d[3:9]}", f"+44 20 7{d[:3]} {d[3:7]}", f"+44 (0)7{d[:3]} {d[3:6]} {d[6:9]}", f"0044 161 {d[:3]} {d[3:7]}"])
    if x == 7:
        a, b = r.randint(201, 989), r.randint(200, 999)
        return _pick(r, [f"({a}) {b}-{d[:4]}", f"{a}-{b}-{d[:4]}", f"{a}.{b}.{d[:4]}", f"+1 {a}-{b}-{d[:4]}", f"+1 ({a}) {b}-{d[:4]}", f"1-{a}-{b}-{d[:4]}"])
    if x == 8:
        return _pick(r, [f"+49 {r.randint(30, 99)} {d[:7]}", f"+49 (0){r.randint(30, 99)} {d[:8]}", f"0{r.randint(30, 9999)}/{d[:7]}", f"(0{r.randint(30, 9999)}) {d[:6]}", f"+49 1{r.randint(50, 79)} {d[:7]}", f"+49-{r.randint(30, 999)}-{d[:7]}"])
    if x == 9:
        return _pick(r, ["+34 ", "0034 ", "+34"]) + _pick(r, "679") + _pick(r, [f"{d[:2]} {d[2:5]} {d[5:8]}", f"{d[:2]} {d[2:4]} {d[4:6]} {d[6:8]}", d[:8]])
    if x == 10:
        return f"+{r.randint(30, 420)} {d[:3]} {d[3:6]} {d[6:9]}"
    return f"+39 0{d[:1]} {d[1:5]} {d[5:9]}"


def identity(r: random.Random) -> str:
    x = r.randrange(8)
    if x < 3:
        body = f"{_pick(r, '12')}{r.randint(30, 99)}{r.randint(1, 12):02d}{_pick(r, [f'{r.randint(1, 95):02d}', '2A', '2B']) if r.random() < 0.2 else f'{r.randint(1, 95):02d}'}{_digits(r, 6)}"
        key = f"{97 - int(body.replace('2A', '19').replace('2B', '18')) % 97:02d}" if r.random() < 0.9 else _digits(r, 2)
        sep = _pick(r, [" ", " ", "", ".", "-"])
        full = _grouped(body, [1, 2, 2, 2, 3, 3], sep)
        return full if r.random() < 0.08 else full + (_pick(r, [sep, sep, " / "]) if sep else "") + key
    if x == 3:
        n = r.randint(10_000_000, 99_999_999)
        s = f"{n:08d}"
        return _pick(r, [s, s, f"{s[:2]}.{s[2:5]}.{s[5:]}"]) + _pick(r, ["", "", "-", " "]) + _DNI_LETTERS[n % 23]
    if x == 4:
        lead, n = r.randrange(3), r.randint(0, 9_999_999)
        return "XYZ"[lead] + _pick(r, ["", "-"]) + f"{n:07d}" + _pick(r, ["", "-"]) + _DNI_LETTERS[int(f"{lead}{n:07d}") % 23]
    if x == 5:
        return f"{r.choice([r.randint(1, 665), r.randint(667, 899)]):03d}-{r.randint(1, 99):02d}-{r.randint(1, 9999):04d}"
    if x == 6:
        a = _pick(r, "ABCEGHJKLMNOPRSTWXYZ") + _pick(r, "ABCEGHJKLMNPRSTWXYZ")
        return a + _pick(r, [" ", " ", ""]).join(["", *(_digits(r, 2) for _ in range(3)), _pick(r, "ABCD")]) if r.random() < 0.6 else a + _digits(r, 6) + _pick(r, "ABCD")
    d = _pick(r, "123456789") + _digits(r, 9)
    p = 10
    for c in d:
        p = 2 * ((int(c) + p) % 10 or 10) % 11
    d += str((11 - p) % 10)
    return d if r.random() < 0.4 else _grouped(d, [2, 3, 3, 3], " ")


def email(r: random.Random) -> str:
    g, f = given(r).lower().replace(" ", ""), _built(r, _TAIL).lower()
    local = _pick(r, [f"{g}.{f}", f"{g[0]}.{f}", f"{g}{r.randint(1, 99)}", f"{f}", f"{g}_{f}", f"{g}-{f}", "contact", "info", f"{f}+news", f"{g[0]}{f}"])
    host, top = _pick(r, [f, f"{f}-{_built(r, _TAIL).lower()}", f"mail.{f}", f"{_built(r, _TOWN_TAIL).lower()}"]), _pick(r, ["fr", "com", "org", "net", "de", "es", "co.uk", "eu", "it", "example", "info", "test", "example.org"])
    x = r.random()
    if x < 0.7:
        return f"{local}@{host}.{top}"
    at = _pick(r, [" [at] ", "[at]", " (at) ", "(at)", " at ", " AT ", " (arobase) ", " arobase ", " [arroba] ", " arroba ", " @ ", "[AT]", " {at} "])
    dot = _pick(r, [" [dot] ", " dot ", ".", ".", " point ", " (dot) ", " DOT ", " punto ", " [point] ", "[dot]", " punkt "])
    return local + at + f"{host}.{top}".replace(".", dot)


def other_number(r: random.Random) -> str:
    d = _digits(r, 16)
    return _pick(
        r,
        [d[:6], d[:9], d[:14], f"{d[:3]} {d[3:6]} {d[6:9]}", f"{d[:3]} {d[3:6]} {d[6:9]} {d[9:14]}", f"{r.randint(1990, 2035)}-{r.randint(1, 12):02d}-{r.randint(1, 28):02d}", f"{r.randint(1, 28):02d}/{r.randint(1, 12):02d}/{r.randint(1990, 2035)}",
         f"{d[:2]}.{d[2:4]}, {d[4:6]}.{d[6:8]}, {d[8:10]}.{d[10:12]}", f"{d[:2]}.{d[2:8]} {d[8:9]}.{d[9:15]}", f"978-{d[:1]}-{d[1:5]}-{d[5:9]}-{d[9]}", f"{r.randint(1, 255)}.{r.randint(0, 255)}.{r.randint(0, 255)}.{r.randint(1, 254)}", f"{r.randint(2, 9)}{d[:8]}", f"{d[:4]}-{d[4:8]}-{d[8:12]}", f"{d[:4]} {d[4:8]} {d[8:12]} {d[12:16]}",
         f"{d[:1]} {d[1:4]} {d[4:7]}", f"v{d[0]}.{d[1]}.{d[2:4]}", f"{d[:5]} {d[5:8]} {_pick(r, 'ABCD')}{_pick(r, 'ABCD')} {d[8:12]}", f"{_pick(r, 'ABEFKLMQR')}{d[:7]}", f"{d[:8]}{_pick(r, 'ABCDEFGHJKLMNPQRSTVWXYZ')}{_pick(r, 'ABC')}", f"{d[:4]}_{d[4:7]}_{d[7:11]}", " ".join(f"{i:02d}" for i in range(r.randint(1, 4), r.randint(6, 9))),
         f"{d[:2]} {d[2:4]} {d[4:6]} {d[6:10]}", f"{d[:10]}", f"{d[:12]}", f"1{d[:2]}99{d[2:12]}", " ".join(f"{r.randint(0, 40)}.{r.randint(0, 9)}" for _ in range(5)), f"{d[:8]}-{d[8:12]}", f"2{d[:4]} {d[4:9]} {d[9:14]}"],
    )


def _word(r: random.Random) -> str:
    return (_built(r, _TAIL) if r.random() < 0.5 else _pick(r, _MIDDLE) + _pick(r, _MIDDLE) + _pick(r, _TAIL)).lower()


def _place(r: random.Random) -> str:
    who = f"{given(r)} {family(r)}" if r.random() < 0.7 else family(r)
    x = r.random()
    if x < 0.45:
        p = _pick(r, _PLACE_FR)
        return f"{p.title() if r.random() < 0.3 else p} {who}"
    if x < 0.65:
        return f"{who} {_pick(r, _PLACE_EN)}"
    if x < 0.8:
        return who.replace(" ", "-") + _pick(r, _PLACE_DE)
    p = _pick(r, _PLACE_ES)
    return f"{p.title() if r.random() < 0.3 else p} {who}"


def _made(r: random.Random) -> str:
    return _pick(r, [f"{_built(r, _TAIL)} {_pick(r, ['Pro', 'Mini', 'One', 'Vantage', 'Plus', 'Series'])}", f"{_built(r, _TAIL)} {r.randint(2, 900)}", f"capteur {_built(r, _TAIL)} {r.randint(1, 40)}", f"{_pick(r, ['modèle', 'model', 'Modell', 'sonde', 'sensor', 'logger'])} {_built(r, _TAIL)}", f"{_pick(r, 'ABCDGHKLPRSTX')}{_pick(r, 'ABCDGHKLPRSTX')}-{r.randint(10, 999)} {_built(r, _TAIL)}"])


def _company(r: random.Random) -> str:
    f = family(r)
    return _pick(r, [f"{f} SA", f"{f} & Fils", f"{f} GmbH", f"{f} Ltd", f"société {f}", f"{f} Énergie", f"{f} Group", f"cabinet {f}", f"{f} Consulting", f"Groupe {f}", f"{f} Systems", f"Firma {f}", f"{f} SARL"])


def _noun(r: random.Random) -> str:
    return _capitals(r).split()[0].title() if r.random() < 0.5 else _built(r, _TAIL + _TOWN_TAIL)


def _capitals(r: random.Random) -> str:
    x = r.random()
    if x < 0.5:
        return _pick(r, _COMMON)
    if x < 0.65:
        return _pick(r, _COMMON).upper()
    from .privacy import CALENDAR, _words

    known = _capitals.known = getattr(_capitals, "known", None) or sorted(w for w, c in _words.items() if c in (2, 4) and len(w) > 3) or sorted(CALENDAR)
    return " ".join(_pick(r, known).title() for _ in range(r.randint(2, 3)))


def _handle(r: random.Random) -> str:
    g, f = given(r).replace("-", ""), _built(r, _TAIL)
    return _pick(r, [f"{g}{r.randint(1, 99)}", f"{g.lower()}_{f.lower()}", f"{f}{r.randint(1, 2000)}", f"{g.lower()}{f.lower()}", f"{g}{f}", f"x{f}x", f"{f.lower()}-{r.randint(1, 99)}"])


_MAKE = {
    "N": person, "F": family, "S": family, "A": address, "P": phone, "I": identity, "E": email, "W": town, "D": lambda r: _digits(r, r.choice((6, 15))), "U": other_number, "L": _capitals, "K": _place, "M": _made,
    "H": _handle, "R": _word, "C": _company, "Q": lambda r: "".join(_pick(r, "ABCDEFGHILMNOPRSTUV") for _ in range(r.randint(2, 5))), "B": _noun,
}


def fill(frame: str, r: random.Random) -> tuple[str, list[tuple[int, int, str]]]:
    """A sentence and its labels (start, end, kind)."""
    out, labels, at, n = [], [], 0, 0
    strange = r.random() < 0.3

    def plain_words(s: str) -> str:
        return re.sub(r"(?<![\w{])[a-zà-ÿ]{3,}(?!\w)", lambda m: _word(r) if r.random() < 0.7 else m[0], s) if strange else s

    if frame[0].isalpha() and r.random() < 0.3:
        frame = frame[0].upper() + frame[1:]
    for m in _SLOT.finditer(frame):
        before = plain_words(frame[at : m.start()])
        at = m.end()
        if m[1] == "T":
            title, value = titled(r)
            before += title
        else:
            value = _MAKE[m[1]](r)
        out += [before, value]
        n += len(before)
        if m[1] in _KIND:
            labels.append((n, n + len(value), _KIND[m[1]]))
        n += len(value)
    out.append(plain_words(frame[at:]))
    text = "".join(out)
    # A sentence rarely stands alone: words before and after it.
    if r.random() < 0.5:
        lead = _pick(r, [f"{_word(r).title()} {_word(r)} {_word(r)}. ", f"{_word(r)} {_word(r)} ", "\n", f"{_word(r).title()} :\n", "> ", "- ", "• "])
        text, labels = lead + text, [(a + len(lead), b + len(lead), k) for a, b, k in labels]
    if r.random() < 0.4:
        text += _pick(r, [f" {_word(r).title()} {_word(r)} {_word(r)}.", f" {_word(r)} {_word(r)}", "\n", f"\n{_word(r).title()} {_word(r)}", f", {_word(r)}"])
    return text, labels


#: Text without personal information is the rule: frames without any are repeated so many times as often.
OTHERS = 3


def sentences(repeats: int = 8, seed: int = 7, frames: tuple[str, ...] = FRAMES, others: int = OTHERS) -> list[tuple[str, list[tuple[int, int, str]]]]:
    """``repeats`` sentences of every frame, ``others`` times as many of those without a label, in a random but fixed order."""
    from .privacy import common_words, know

    know(common_words())
    r = random.Random(seed)
    labelled = [any(m in _KIND or m == "T" for m in _SLOT.findall(f)) for f in frames]
    out = [fill(f, r) for f, yes in zip(frames, labelled, strict=True) for _ in range(repeats if yes else repeats * others)]
    r.shuffle(out)
    return out
