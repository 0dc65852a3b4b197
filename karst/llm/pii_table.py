"""A labelled table for personal information, written without sight of the texts it is used on.

Sentences of everyday life in four languages hold slots: {n} name, {e} email, {p} phone, {i} identity number, {a} address;
the other slots are filled with things that look alike and are none. Values come from public formats (numbering plans,
identity cards, postal conventions). Words are put in and left out at random, so that no sentence is learned by heart.
"""

from __future__ import annotations

import random
import re

KINDS = ["email", "phone", "id_number", "address", "name"]
SLOT_KINDS = {"e": "email", "p": "phone", "i": "id_number", "a": "address", "n": "name"}

# Sentences by language. {T} is a title, {N} a name after a title, {x} a thing, {D} a date, {H} a time, {M} money, {Q} a
# ticket, {O} an order, {V} a version, {U} a handle, {B} a bot, {R} a remote login, {S} a host, {L} a place, {F} a file, {K} some other number.
SENTENCES = {
    "en": """
my {c} is {i}
the {c} {i} has expired
could you check my {c}, {i}, please
her new {c} reads {i}
the {o} {O} is late
my {o} is {O}, can you check?
{O} is the {o} you asked for
please {d} me on {p} or {p}
I tried {p} twice
{p} rings but nobody answers
{n} phoned the school about the swimming lesson
we are waiting for {n}
{n} left a jacket in the gym
could you ask {n} whether the piano is tuned
the plumber, {n}, comes on {D}
a parcel for {n} is at the reception
my neighbour {n} feeds the cat
{n} and {n} are sharing a taxi to {L}
{T} {N} will see you at {H}
an appointment with {T} {N} was moved to {D}
dear {n}, thank you for the flowers
dear {T} {N}, your application arrived on {D}
sincerely, {n}
best wishes\\n{n}
kind regards,\\n{n}
love, {n} x
our new trainer is called {n}
{n} wrote the minutes of the meeting
give my regards to {n}
it was {n} who found the keys
nobody but {n} has the code for the garage
tell {n} that the bakery closes at {H}
{n}'s bicycle is still in the yard
I borrowed the drill from {n}
the visitor badge says {n}
{n} is off sick until {D}
did {n} pay the {M} for the trip?
{n}? no idea where they went
yes {n}, that is fine
morning {n}
hello {n}
hi {n}, the choir meets at {H}
ok {n} see you in {L}
happy birthday {n}!
well done {n}
welcome aboard, {n}!
spoke to {n} on the phone, they agree
reviewed by {n}, approved by {n}
contact: {n}, {p}
patient {n}, born {D}, insurance number {i}
tenant: {n}, flat rented since {D}
emergency contact {n} {p}
{n} lives at {a}
{n} moved to {a} last spring
send the contract to {n}, {a}
please deliver the sofa to {a}
we meet at {a} at {H}
the workshop is in {a}
the office moved from {a} to {a}
my address is {a}
billing address: {a}
home address {a}
return the books to {a} before {D}
the party is at {a}, ring twice
a taxi to {a}, please
they live over at {a}, near the station
ring me on {p}
call {p} after {H}
you can reach the caretaker under {p}
my number is {p}
text me: {p}
her mobile is {p}
office line {p}, ext. {K}
fax {p}
tel: {p}
tel. {p}
the hotline {p} is busy all day
{p} is the number of the surgery
whatsapp {p}
ask for {n} on {p}
missed call from {p} at {H}
write to {e}
send the photos to {e}
my mail address is {e}
mail {e} or ring {p}
invoices go to {e} please
{e} bounced twice
cc {e} and {e}
please forward this to {e}, thanks
I can be reached at {e}
the account {e} is locked
from: {e}
to: {n} <{e}>
{n} <{e}> wrote on {D}:
{n} ({e}) joined the list
my passport number is {i}
passport {i} expires on {D}
social security number: {i}
ssn {i}
her national insurance number is {i}
id card no. {i}
driving licence {i}
identity document {i}, issued {D}
the form asks for my tax id, which is {i}
{n}, id {i}
please verify {i} against the register
{U} could you look at {Q}
{U} {U} any news?
thanks {U}!
{B} closed {Q}
{B} could not merge the branch
run {R} and check the disk
{R} works from the office only
log in with {R}
the machine {S} is down again
{S} answers on port {K}
ping {S} fails
upgrade to {V} on {D}
{V} breaks the export, stay on {V}
build {K} failed after {K} minutes
order {O} has been shipped
where is my order {O}?
your order no. {O} arrives on {D}
ticket {Q} is still open
see {Q} and {Q}
invoice {O} over {M} is due on {D}
the file {F} is missing
open {F} and search for {K}
the train leaves {L} at {H}
{L} was cold and wet in May
we drove from {L} to {L} on Monday
the {x} costs {M}
the {x} in {L} opens on {D}
{K} people signed up, {K} came
error {K} in line {K}
room {K}, second floor
the meeting on {D} takes place in {L}
chapter {K} explains the {x}
does anyone need a {x}?
I lost my {x} somewhere in {L}
The Monday group starts at {H}
Spring is the best season for a {x}
Please bring a {x} and some water
The {x} from Italy was delicious
Will there be a {x} at the fair?
May I borrow the {x} for a week?
Hope the {x} works now
Mark the {x} as done
Grace period ends on {D}
the price rose from {M} to {M}
checksum {K} does not match
tracking number {O}
serial {O}, model {V}
it rained for {K} days
in {C} the {x} is cheaper
the {C} sale ends soon
between {C} and {C} nothing happens
{C} was rainy this year
since last {C} the {x} is broken
we meet again in {C}
next {C} we replace the {x}
the {x} opens in {C} {K}
{C} and {C} are the busy months
late {C} or early {C}
{C} {x} plans are out
{C} hours start on {D}
{C} has started and the {x} is back
{C}: new {x}, old {x}
the {x} of {C} was better
a {C} {x} for everyone
{C} holidays, {C} prices
our {C} {x} begins at {H}
{x} in {C}?
opened {F}, hit {O}, closed it
see https://{S}/{x}?id={O}
https://{S}/{x}/{O}?id={k}&ref={O}
it may snow, bring a rose and some art
please mark the bill as paid, the grant will cover it
I hope the dawn is clear and the frost is gone
with joy and grace she read the will
the robin sings, the lily and the iris bloom
a penny for the guide, said the carpenter
the ray of light hit the jade lamp
art class is full, but we will frank the letter
they drew a hazel tree by the brook
the hunter, the mason and the baker met at the mill
the amber light is on, turn left at the lane
you may need a pen, a basil plant and a pearl
{k} of {k} boxes packed, {k} left
{k} seats, {k} rows, {k} per table
copied {k} pages and {k} photos, skipped {k}
{k} done, {k} open, {k} late
took {k} ms for {k} rows
response time {k} ms, {k} users
uses {k} MB of {k} MB
balance {M}, fee {M}
page {k} of {k}, id={O}
account {O} has {M}
they live in Rose Lane or in Mill Lane, nobody knows
the lane is closed, take the other lane
ISBN {I}
the book with ISBN {I} is sold out
part {O}, batch {O}
card reader {O} is offline
coordinates {G}
the office at {G}
The {x}-{X} job is slow
our {X} team moved the {x}-{x} service
{X} {X} is a great album
the {X} Museum and the {X} Theatre are open
the {X} {X} conference
{n}, {n} and {n} are in
{n}: thanks
{n} - thank you
with {n} away, who waters the plants?
{n} can't come, {n} can
@{x} {n} says hi
talk to {n} or {n}
{n}, {K} years old
{K}. {n}
id: {i}
ID {i}
number {i} on the card
{i} is on my permit
reach me: {e} / {p}
{p} or {p}
{e}, {e}, {e}
visit us: {a}
""",
    "de": """
meine {c} lautet {i}
die {c} {i} ist abgelaufen
die {o} {O} ist verspätet
meine {o} ist {O}
unter {p} geht niemand ran
{n} hat in der Schule angerufen
wir warten noch auf {n}
ist {n} heute im Büro?
{T} {N} kommt um {H}
der Termin bei {T} {N} ist am {D}
Sehr geehrte {T} {N}, Ihr Antrag ist eingegangen
Sehr geehrter {T} {N}, vielen Dank für das Gespräch
Liebe {n}, danke für die Blumen
Lieber {n}, wie geht es dir?
Mit freundlichen Grüßen\\n{n}
Viele Grüße, {n}
LG {n}
hallo {n}
Hallo {n}, der Chor trifft sich um {H}
guten Morgen {n}
danke dir {n}!
frag mal {n}
{n} und {n} fahren zusammen nach {L}
das Fahrrad gehört {n}
Ansprechpartner: {n}, Telefon {p}
{n} wohnt in der {a}
{n} ist in die {a} gezogen
wir treffen uns in der {a}
die Werkstatt ist in der {a}
Lieferung bitte an {n}, {a}
Anschrift: {a}
meine Adresse ist {a}
Wohnhaft: {a}
schick das Paket an {a}
ruf mich an: {p}
meine Nummer ist {p}
Tel. {p}
Telefon: {p}
Handy {p}
du erreichst mich unter {p}
Rückfragen unter {p} oder {e}
schreib an {e}
meine Mail ist {e}
Rechnungen bitte an {e}
E-Mail: {e}
die Adresse {e} ist gesperrt
mein Personalausweis hat die Nummer {i}
Ausweisnummer {i}
Reisepass {i}, gültig bis {D}
Steuer-ID {i}
Steuernummer: {i}
Sozialversicherungsnummer {i}
{n}, geboren am {D}, Ausweis {i}
gestern hat {n} den Kuchen gebacken
nur {n} kennt den Code der Garage
morgen übernimmt {n} den Dienst
das Protokoll schreibt {n}
{n} ist krank bis {D}
{U} schaust du dir {Q} an?
{B} hat {Q} geschlossen
mit {R} anmelden
der Rechner {S} antwortet nicht
Fassung {V} kommt am {D}
die Bestellung {O} ist unterwegs
Auftrag {O} über {M}
das Ticket {Q} ist noch offen
Der Zug nach {L} fährt um {H}
Die Prüfung findet am {D} in {L} statt
Das Gerät kostet {M}
Der Vertrag läuft bis {D}
Im Sommer ist die Stadt {L} sehr voll
Die Straße nach {L} ist gesperrt
Der Preis stieg von {M} auf {M}
In Zeile {K} steht ein Fehler
Die Datei {F} fehlt
Das Team hat {K} Punkte geholt
Heute gibt es Suppe und Brot
Der Schlüssel liegt im Schrank
Am Montag ist der Laden zu
Bitte den Müll am Freitag rausstellen
Kapitel {K} handelt von der Brücke
Die Rechnung {O} ist fällig am {D}
Wer hat den Beamer im Raum {K} gesehen?
Gruppe {K} trifft sich in der Halle
im {C} ist der Laden zu
Ende {C} oder Anfang {C}
seit {C} ist das Gerät kaputt
der {C} war nass
{k} von {k} Kisten gepackt, noch {k}
{k} Seiten, {k} Bilder, {k} Fehler
der {x}-Dienst läuft wieder
die {x}-Seite und der {x}-Server sind langsam
das {X}-Team trifft sich um {H}
der {X}-Vertrag gilt bis {D}
das {X}-Museum ist zu
Schöne Grüße, {n}
Tschüss, {n}
Dein {n}
{n} kommt später, {n} auch
kannst du {n} fragen?
Bis morgen, {n}
ISBN {I}
Ausweis {i}
ID: {i}
""",
    "fr": """
mon {c} est le {i}
le {c} {i} a expiré
la {o} {O} est en retard
ma {o} est la {O}
le {p} ne répond pas
{n} a téléphoné à l'école
nous attendons {n}
est-ce que {n} vient ce soir ?
{T} {N} vous recevra à {H}
le rendez-vous avec {T} {N} est le {D}
Bonjour {T} {N}, votre dossier est complet
bonjour {n}
Salut {n}, on se voit à {H}
Chère {n}, merci pour les fleurs
Cher {n}, comment vas-tu ?
Cordialement,\\n{n}
Bien à vous, {n}
bises, {n}
demande à {n} si le piano est accordé
{n} et {n} partagent un taxi pour {L}
c'est {n} qui a les clés
le vélo de {n} est dans la cour
{n} habite {a}
{n} a déménagé au {a}
rendez-vous au {a} à {H}
adresse : {a}
mon adresse est {a}
livrer le colis à {n}, {a}
l'atelier se trouve {a}
appelle-moi au {p}
mon numéro est le {p}
tél. {p}
téléphone : {p}
portable {p}
on peut me joindre au {p}
écrivez à {e}
mon courriel est {e}
les factures à {e} svp
courriel : {e}
contactez {n} au {p} ou à {e}
numéro de sécurité sociale {i}
ma carte d'identité porte le numéro {i}
passeport {i}, valable jusqu'au {D}
n° fiscal {i}
{n}, née le {D}, carte {i}
hier {n} a préparé le gâteau
{n} est malade jusqu'au {D}
le compte rendu est écrit par {n}
{U} tu peux regarder {Q} ?
{B} a fermé {Q}
se connecter avec {R}
la machine {S} ne répond plus
la version {V} sort le {D}
la commande {O} est partie
commande {O} de {M}
le ticket {Q} reste ouvert
Le train pour {L} part à {H}
La réunion du {D} a lieu à {L}
Le prix passe de {M} à {M}
Le fichier {F} manque
Il y a une erreur à la ligne {K}
Les enfants jouent dans la cour
La boulangerie ferme le lundi
Demain il fera beau à {L}
Le chapitre {K} parle du pont
L'équipe a gagné {K} points
La facture {O} est à payer avant le {D}
Qui a vu le projecteur de la salle {K} ?
La route de {L} est fermée
en {C} le magasin est fermé
depuis {C} la machine est en panne
fin {C} ou début {C}
{k} cartons sur {k} sont prêts, reste {k}
{k} pages, {k} images, {k} erreurs
le service {x}-{x} est lent
le musée {X} est ouvert
l'équipe {X} a déménagé
À demain, {n}
ton ami {n}
{n} arrive plus tard, {n} aussi
ISBN {I}
carte n° {i}
identifiant {i}
""",
    "es": """
mi {c} es {i}
el {c} {i} ha caducado
la {o} {O} llega tarde
mi {o} es {O}
en el {p} no contesta nadie
{n} llamó a la escuela
estamos esperando a {n}
¿viene {n} esta noche?
{T} {N} le atenderá a las {H}
la cita con {T} {N} es el {D}
Estimada {T} {N}, su solicitud ha llegado
Estimado {T} {N}, gracias por la visita
hola {n}
Hola {n}, nos vemos a las {H}
Querida {n}, gracias por las flores
Querido {n}, ¿cómo estás?
Un saludo,\\n{n}
Saludos cordiales, {n}
besos, {n}
dile a {n} que la panadería cierra a las {H}
{n} y {n} comparten un taxi a {L}
la bicicleta es de {n}
{n} vive en {a}
{n} se mudó a {a}
quedamos en {a} a las {H}
dirección: {a}
mi dirección es {a}
entregar el paquete a {n}, {a}
el taller está en {a}
llámame al {p}
mi número es {p}
tel. {p}
teléfono: {p}
móvil {p}
me puedes localizar en el {p}
escribe a {e}
mi correo es {e}
las facturas a {e} por favor
correo: {e}
contacta con {n} en el {p} o en {e}
mi DNI es {i}
DNI {i}
NIE {i}
pasaporte {i}, válido hasta el {D}
número de la seguridad social {i}
{n}, con documento {i}
ayer {n} preparó la cena
{n} está de baja hasta el {D}
el acta la escribe {n}
{U} ¿puedes mirar {Q}?
{B} cerró {Q}
entra con {R}
la máquina {S} no responde
la versión {V} sale el {D}
el pedido {O} va en camino
pedido {O} por {M}
el ticket {Q} sigue abierto
El tren a {L} sale a las {H}
La reunión del {D} es en {L}
El precio sube de {M} a {M}
Falta el archivo {F}
Hay un error en la línea {K}
Los niños juegan en el patio
La tienda cierra los lunes
Mañana hará sol en {L}
El capítulo {K} trata del puente
La factura {O} vence el {D}
¿Quién ha visto el proyector de la sala {K}?
en {C} la tienda está cerrada
desde {C} la máquina está rota
a finales de {C} o en {C}
{k} cajas de {k} están listas, quedan {k}
{k} páginas, {k} imágenes, {k} errores
el servicio {x}-{x} va lento
el museo {X} está abierto
el equipo {X} se ha mudado
Hasta mañana, {n}
tu amiga {n}
{n} llega más tarde, {n} también
ISBN {I}
documento {i}
identificación: {i}
""",
}
# What identity numbers, phones and other numbers are called; used in the sentences of all languages.
CALLED = """
{c} {i}
{c}: {i}
{c} no. {i}
{c} ({i})
{c} = {i}
{c} n° {i}
{i} ({c})
{n}, {c} {i}
{c} {i}, {d} {p}
{d} {p}
{d}: {p}
{d} ({p})
{d} {p} / {e}
{o} {O}
{o}: {O}
{o} no. {O}
{o} n° {O}
{o} {O} ({D})
{o} {O}, {o} {O}
"""
CUES = {
    "c": {
        "en": "passport; passport number; ID; id card; SSN; social security; NI number; national insurance; driving licence; driver's license; tax ID; tax number; residence permit; identity card; citizen number; NHS number".split("; "),
        "de": "Ausweis; Ausweisnummer; Personalausweis; Perso; Reisepass; Passnummer; Steuer-ID; Steuernummer; Sozialversicherungsnummer; Führerschein; Aufenthaltstitel; Versichertennummer".split("; "),
        "fr": "passeport; carte d'identité; CNI; numéro de sécu; sécurité sociale; permis de conduire; numéro fiscal; titre de séjour; NIR; pièce d'identité".split("; "),
        "es": "DNI; NIE; NIF; pasaporte; documento; carné de conducir; seguridad social; número fiscal; permiso de residencia; cédula; CURP".split("; "),
    },
    "d": {
        "en": "call; phone; tel; mobile; cell; ring; text; dial; fax; whatsapp; landline; number".split("; "),
        "de": "Tel; Tel.; Telefon; Handy; Mobil; Festnetz; Rückruf; Durchwahl; ruf an; Fax; Nummer".split("; "),
        "fr": "tél; tél.; téléphone; portable; mobile; fixe; appelle le; fax; numéro; joindre au".split("; "),
        "es": "tel; tel.; teléfono; móvil; fijo; llama al; fax; número; celular; contacto".split("; "),
    },
    "o": {
        "en": "order; order number; invoice; ticket; tracking; parcel; case; booking; reservation; account; customer number; batch; contract; reference; serial; transaction; product; item; receipt".split("; "),
        "de": "Bestellung; Bestellnummer; Rechnung; Auftrag; Sendung; Vorgang; Buchung; Kundennummer; Vertrag; Charge; Referenz; Artikel; Beleg".split("; "),
        "fr": "commande; facture; colis; dossier; réservation; numéro de client; contrat; lot; référence; article; reçu".split("; "),
        "es": "pedido; factura; paquete; expediente; reserva; número de cliente; contrato; lote; referencia; artículo; recibo".split("; "),
    },
}

# Texts that are pasted rather than written, in any language.
PASTED = """
{{"name": "{n}", "mail": "{e}"}}
{{"customer": {{"name": "{n}", "phone": "{p}"}}, "total": {K}}}
{{"id": {K}, "host": "{S}", "level": "warn"}}
{{"user": "{e}", "ip": "{S}", "ok": true}}
{{"order": "{O}", "status": "open", "version": "{V}"}}
{{"street": "{a}", "country": "{L}"}}
{{"from":"{e}","to":"{e}","at":"{D}"}}
{{"tel":"{p}","doc":"{i}","name":"{n}"}}
{{"done":{k},"left":{k},"host":"{S}"}}
to={e};cc={e};by={n}
{n}<{e}>
({p})
[{e}]
"{n}" "{a}"
tel:{p}
mail:{e}
mailto:{e}?subject={x}
doc:{i}
a={k} b={k} c={k}
{k}/{k} {x} {k}%
ISBN:{I}
name: {n}\\nphone: {p}\\nmail: {e}
name={n}; tel={p}; doc={i}
{n};{e};{p}
{n}\t{p}\t{a}
{n},{e},{D}
host: {S}\\nport: {K}\\nversion: {V}
{D} {H} INFO {S} started in {K} ms
{D} {H} ERROR job {K} failed: {F}
[{H}] {U}: any news on {Q}?
[{H}] {n}: any news on {Q}?
> {n} wrote:\\n> see you at {H}
> {U} wrote:\\n> see {Q}
--\\n{n}\\n{a}\\n{p}
--\\n{n} | {p} | {e}
{n}\\n{p}
{n}, {a}
{e}
{p}
{n}
Signed-off-by: {n} <{e}>
Author: {n} <{e}>
reviewer: {n}
owner: {U}
- {n}\\n- {n}\\n- {n}
1. {n}\\n2. {n}
$ {R}
{R}
{R}: permission denied
{F}:{K}: warning: unused
{x}=={V}
{x}@{V}
{x}@latest
git clone git@{S}:{x}/{x}.git
https://{S}/{x}/{x}?page={K}
https://{x}@{S}/{x}.git
https://{S}/{x}?id={O}
http://{S}/{x}/{x}#{O}
https://{x}:{x}@{S}/{x}.git
postgres://{x}:{x}@{S}/{x}
| {n} | {p} |
| {x} | {K} |
UPDATE users SET mail = '{e}' WHERE id = {K};
SELECT {x} FROM {x} WHERE id = {K}
<a href="mailto:{e}">{n}</a>
BEGIN:VCARD\\nFN:{n}\\nTEL:{p}\\nEND:VCARD
{Q}: {x} {x}
{Q} {Q} {Q}
{O}
{D}
{V}
{K}, {K}, {K}
+{K} -{K}
@{x} {x}
"""

# Public names, words and places; most names in a table are invented or come from a list, for texts hold more names than any list.
GIVEN = """Anna Ben Clara David Emma Felix Greta Hugo Irene Jonas Karin Leo Maria Nils Olga Paul Quentin Rita Simon Tanja Ursula Victor Wendy Xavier Yvonne Zoe Aisha Bilal Chiara Dmitri Elif Farid
Giulia Hiroshi Ingrid Javier Kofi Lucía Mateo Noor Oisín Priya Rajesh Søren Thandiwe Uma Wei Yusuf Zsófia Amélie Benoît Céline François Hélène Jérôme Mónica José Ángel Begoña Íñigo Jürgen Björn Käthe
James John Robert Michael William Richard Thomas Daniel Matthew Andrew Joshua Kevin Brian George Edward Mary Patricia Jennifer Linda Elizabeth Susan Jessica Sarah Karen Nancy Lisa Emily Laura Amy Megan Hannah Alice Lucy Jack
Oliver Harry Charlie Thorsten Stefan Andreas Klaus Dieter Wolfgang Sabine Petra Monika Heike Anke Lena Lukas Pierre Jean Michel Philippe Nicolas Julien Camille Chloé Manon Sophie Marie Juan Carlos Luis Pedro Miguel
Carmen Pilar Isabel Marta Pablo Diego Sergio Marco Luca Francesca Ahmed Fatima Omar Layla Mohammed Ravi Anjali Arjun Mei Chen Yuki Sakura Olena Ivan Natasha Sven Astrid Lars Kwame Amina Chidi Ngozi Rosa Jorge Sofía""".split()
FAMILY = """Smith Brown Taylor Walker Hughes Morgan Bennett Foster Müller Schmidt Fischer Weber Schäfer Köhler Vogel Dupont Martin Lefèvre Moreau Girard Rousseau García Fernández López Muñoz Ortega Ibáñez Romero
Rossi Bianchi Novak Kowalski Nguyen Tran Patel Sharma Khan Yılmaz Okafor Mensah Tanaka Suzuki Kim Park Chen Wang Ivanov Petrova Nielsen Johansson Virtanen Papadopoulos Silva Santos
Jones Williams Davis Miller Wilson Moore Anderson Thomas Jackson White Harris Clark Lewis Robinson Young Allen King Wright Scott Hill Green Adams Baker Nelson Carter Mitchell Roberts Turner Phillips Campbell Parker Evans
Edwards Collins Meyer Wagner Becker Schulz Hoffmann Koch Richter Klein Wolf Schröder Neumann Schwarz Zimmermann Braun Krüger Bernard Dubois Petit Durand Leroy Simon Laurent Michel Fournier Mercier Rodríguez González Martínez
Sánchez Pérez Gómez Díaz Hernández Torres Ruiz Álvarez Jiménez Moreno Castro Ortiz Ramos Herrera Singh Kumar Gupta Ali Ahmed Hassan Mohamed Lee Zhang Liu Yang Popov Horvat Nagy Hansen Larsen Costa Ferreira""".split()
WORDS = {k: [w for w in re.findall(r"(?<![\w{])[^\W\d_]{2,}(?![\w}])", v) if k == "de" or w.islower()] for k, v in SENTENCES.items()}
TITLES = {"en": "Mr Mr. Mrs Mrs. Ms Ms. Miss Dr Dr. Prof. Professor Doctor Sir Nurse".split(), "de": "Herr Frau Herrn Dr. Prof. Doktor".split(), "fr": "M. Mme Mlle Dr Monsieur Madame Me".split(), "es": "Sr. Sra. Srta. Don Doña D. Dr. Dra. señor señora".split()}
PLACES = """London Leeds Boston Denver Paris Lyon Lille Nantes Berlin Hamburg Köln Leipzig Madrid Sevilla Bilbao Granada Rome Vienna Zürich Prague Oslo Porto Brussels Canada Spain France Deutschland España
Australia Texas Bavaria Scotland Norway Geneva Dublin Kyoto""".split()
THINGS = """umbrella kettle ladder printer violin notebook blanket bridge garden keyboard lantern router helmet ticket camera engine window cable backpack compass server database parser scheduler queue cache
index worker gateway proxy report dashboard invoice release branch deploy pipeline cluster schema table payment search login""".split()
MONTHS_EN = "January February March April May June July August September October November December Spring Summer Autumn Winter spring summer winter".split()
MONTHS_DE = "Januar Februar März April Mai Juni Juli August September Oktober November Dezember Sommer Winter Frühling Herbst".split()
MONTHS_FR = "janvier février mars avril mai juin juillet août septembre octobre novembre décembre".split()
MONTHS_ES = "enero febrero marzo abril mayo junio julio agosto septiembre octubre noviembre diciembre".split()
FILLERS = {
    "en": "please; ok; thanks; hm; by the way; sorry; quick question; fyi; also; so; yes; no; lol; great; anyway; sure; right; btw; done; note; reminder; one more thing".split("; "),
    "de": "bitte; okay; danke; hm; übrigens; sorry; kurze Frage; also; ja; nein; super; genau; noch etwas; erledigt; Achtung; naja".split("; "),
    "fr": "svp; d'accord; merci; euh; au fait; désolé; petite question; donc; oui; non; super; voilà; encore une chose; attention".split("; "),
    "es": "por favor; vale; gracias; eh; por cierto; perdón; una pregunta; entonces; sí; no; genial; eso; otra cosa; atención".split("; "),
}
TLDS = "com org net de fr es io info eu co.uk ch at edu dev app it nl example test".split()
STREETS = {
    "en": "Street St St. Road Rd Rd. Avenue Ave Ave. Lane Ln Drive Dr Court Ct Place Square Way Close Crescent Terrace Boulevard Blvd Hill Grove Row".split(),
    "fr": "rue;rue de la;rue du;rue des;avenue;avenue de;boulevard;bd;place;place du;chemin;chemin des;allée des;impasse;quai;route de;cours".split(";"),
    "es": "Calle;C/;calle;Avenida;Avda.;Av.;Plaza;Paseo;Paseo de;Camino;Ronda;Carrera;Travesía;Calle del;Calle de la".split(";"),
}
UNITS = "ms s h min kB MB GB % km kg rows req/s EUR USD GBP CHF MHz px l m² °C dB V".split()
LEADS = ["at ", "to ", "from ", "in ", "is ", "by ", "an ", "bei ", "nach ", "von ", "à ", "chez ", "de ", "en ", "a ", "(", '"', ": ", "- ", "= ", "new: ", "old ", "not ", "maybe ", "> ", "<b>"]
EMOJI = "🙂 😀 👍 🎉 🚀 😅 ❤️ 🙏 👋 ☕".split()


class Table:
    """Draws labelled messages; the same seed draws the same."""

    def __init__(self, seed: int, given: list[str], family: list[str]):
        self.r = random.Random(seed)
        self.lists = {"given": given, "family": family}

    def one(self, xs):
        return self.r.choice(xs)

    def chance(self, p: float) -> bool:
        return self.r.random() < p

    def digits(self, n: int) -> str:
        return "".join(self.r.choice("0123456789") for _ in range(n))

    def letters(self, n: int) -> str:
        return "".join(self.r.choice("ABCDEFGHJKLMNPRSTUVWXYZ") for _ in range(n))

    def filled(self, form: str) -> str:
        """9 and A of a form become digits and letters; what stands between quotes stays."""
        return "".join(x[1:-1] if x[0] == "'" else self.digits(1) if x == "9" else self.letters(1) if x == "A" else x for x in re.findall(r"'[^']*'|.", form))

    def invented(self, parts: int = 2) -> str:
        on = "b br c ch d dr f g gr h j k kl l m n p pr r s sch st t th tr v w z".split()
        mid, end = "a e i o u ai ei ie ou au ö ü é á".split(), ["", "", "n", "r", "l", "s", "t", "ck", "nd", "m", "tz"]
        return "".join(self.one(on) + self.one(mid[:5] if self.chance(0.8) else mid) for _ in range(parts)) + self.one(end)

    # -- items ------------------------------------------------------------------------------------------------------

    def given(self) -> str:
        x = self.r.random()
        s = self.one(self.lists["given"]) if x < 0.4 and self.lists["given"] else self.one(GIVEN) if x < 0.55 else (self.invented(self.one([1, 2])) + self.one(["a", "o", "e", "ine", "us", ""])).capitalize()
        return f"{s}-{self.one(GIVEN)}" if self.chance(0.04) else s

    def family(self) -> str:
        x = self.r.random()
        s = self.one(self.lists["family"]) if x < 0.4 and self.lists["family"] else self.one(FAMILY) if x < 0.55 else (self.invented(self.one([1, 2, 2])) + self.one(["son", "er", "ez", "ski", "mann", "elli", "ström", "ier", "wick", "ton", "ley", "", ""])).capitalize()
        if self.chance(0.1):
            s = self.one(["O'", "Mc", "Mac", "de ", "von ", "van ", "van der ", "del ", "de la ", "Le ", "di ", "el-", "D'"]) + s
        return f"{s}{self.one(['-', ' '])}{self.one(FAMILY)}" if self.chance(0.07) else s

    def name(self, lang: str, titled: bool = False) -> str:
        x = self.r.random()
        if titled:
            s = self.family() if x < 0.6 else f"{self.given()} {self.family()}"
        else:
            s = self.given() if x < 0.33 else f"{self.given()} {self.family()}" if x < 0.82 else f"{self.letters(1)}. {self.family()}" if x < 0.9 else f"{self.given()} {self.letters(1)}. {self.family()}" if x < 0.95 else f"{self.letters(1)}.{self.one(['', ' '])}{self.letters(1)}. {self.family()}" if x < 0.975 else f"{self.family()}, {self.given()}"
        return s.upper() if self.chance(0.02) else s

    def host(self) -> str:
        a = self.one(THINGS) if self.chance(0.4) else self.invented(self.one([1, 2, 3]))
        return f"{a}{self.one(['', '', '', '-' + self.one(THINGS), '.' + self.invented(1), self.digits(1), self.digits(2), f'.{self.invented(1)}{self.digits(1)}'])}.{self.one(TLDS)}"

    def email(self, lang: str) -> str:
        plain = lambda s: re.sub(r"[^a-z-]", "", s.lower()) or "x"
        g, f = plain(self.given()), plain(self.family())
        local = self.one([f"{g}.{f}", f"{g}.{f}", f"{g}", f"{g[0]}{f}", f"{g[0]}.{f}", f"{g}_{f}", f"{f}{self.digits(2)}", f"{g}-{f}", f"{g}+{self.one(THINGS)}", f"{g}.{f}{self.digits(1)}", self.one(["info", "office", "sales", "help", "team", "billing", "hello"]), f"{f}.{g}", f"{g}{f}"])
        if self.chance(0.3):  # local parts of any form
            local = "".join(self.one([g, f, self.invented(1), self.digits(self.one([1, 2, 3, 4])), self.one(THINGS), f[0]]) + self.one([".", "_", "-", "", "", "+", "'" if self.chance(0.2) else ""]) for _ in range(self.one([1, 2, 3]))).strip("._-+'")
            local = "".join(c for c in local if ord(c) < 128) or g
        host = self.host()
        if self.chance(0.75):
            s = f"{local}@{host}"
            return s.capitalize() if self.chance(0.04) else s.upper() if self.chance(0.02) else s
        at = self.one(["(at)", " (at) ", "[at]", " [at] ", " at ", " AT ", " @ ", "＠", "{at}", " arroba ", " arobase ", "<at>", " (@) "])
        dot = self.one([".", "."] if at.strip() in ("@", "＠", "(@)") else [".", " dot ", "(dot)", " [dot] ", " DOT ", "[dot]", " punto ", " point ", " Punkt ", " . "])
        return local.replace(".", self.one([".", dot])) + at + host.replace(".", dot)

    def phone(self, lang: str) -> str:
        sep = self.one([" ", " ", "-", ".", "", "/", " - ", "–", "\u00a0", "‑"])
        forms = [
            ["9999", "999999"], ["99999", "999999"], ["999", "9999", "9999"], ["999", "999", "9999"], ["99", "99", "99", "99", "99"], ["999", "99", "99", "99"], ["999", "999", "999"],
            ["9999", "999", "999"], ["999", "99999999"], ["9999", "9999999"], ["99", "9999", "9999"], ["999", "9999"], ["99999", "99999"], ["999", "999999"], ["999", "9999", "999"], ["9999", "99", "99", "99"],
        ]
        parts = [self.digits(len(p)) for p in self.one(forms)]
        cc = self.one(["1", "44", "49", "33", "34", "39", "31", "41", "43", "46", "48", "351", "55", "52", "91", "81", "61", "353", "32", "45"])
        x = self.r.random()
        if x < 0.06:
            return f"1{sep}{self.digits(3)}{sep}{self.digits(3)}{sep}{self.digits(4)}"
        if x < 0.4:
            parts[0] = parts[0].lstrip("0") or "7"
            head = self.one([f"+{cc} ", f"+{cc} ", f"+{cc}", f"+{cc}-", f"+{cc}.", f"00{cc} ", f"(+{cc}) ", f"+{cc} (0)"])
            return head + (f"({parts[0]}) " + sep.join(parts[1:]) if self.chance(0.15) else sep.join(parts))
        if x < 0.75:
            parts[0] = "0" + parts[0][1:]
        if self.chance(0.25):
            return f"({parts[0]}){self.one([' ', '', '-'])}" + sep.join(parts[1:])
        return sep.join(parts)

    def id_number(self, lang: str) -> str:
        forms = [
            "999-99-9999", "999-99-9999", "999 99 9999", "AA 99 99 99 A", "AA999999A", "AA 999999 A", "AA-99-99-99-A", "99999999A", "99999999-A", "99.999.999-A", "'X'9999999A", "'Y'-9999999-A", "'Z'9999999A",
            "A99999999", "A9999999", "AA9999999", "99AA99999", "999999999", "A99A99A99", "A99'X'99'T'99", "9 99 99 99 999 999", "9 99 99 99 999 999 99", "9999999999999", "999999999999999", "99 999 999 999", "99999999999",
            "99/999/99999", "99 999999 A 999", "99999999A999", "AAA999999", "9999-9999-9999", "9999 9999 9999", "99999 A 9999", "999999-9999", "AAAAA999999AA9AA", "999.999.999-99", "A-99999999", "999999/9999",
        ]
        if self.chance(0.12):  # licences and the like, in any form
            s = "".join(self.one("A9") * self.one([1, 2, 3]) for _ in range(self.r.randint(3, 6)))
            return self.filled(s + "9" * max(0, 4 - s.count("9")))
        return self.filled(self.one(forms))

    def street(self) -> str:
        s = self.one(["Church", "Mill", "Station", "Park", "Oak", "Maple", "High", "King", "Garden", "River", "North", "Bridge", "Castle", "Orchard", "Victoria"]) if self.chance(0.35) else self.invented(self.one([1, 2])).capitalize()
        s = s if self.chance(0.85) else f"{s} {self.invented(1).capitalize()}"
        return s if self.chance(0.85) else f"{self.one(['N.', 'S.', 'E.', 'W.', 'North', 'West', 'St.', 'Old', 'Upper', 'Little', 'SE', 'Mt.'])} {s}"

    def town(self) -> str:
        return self.one(PLACES) if self.chance(0.4) else self.invented(2).capitalize()

    def address(self, lang: str) -> str:
        no = str(self.r.randint(1, 220)) + (self.one(["", "", "", "", "a", "b", " b", "-" + str(self.r.randint(2, 90))]))
        if lang == "en":
            s = f"{no} {self.street()} {self.one(STREETS['en'])}"
            if self.chance(0.25):
                unit = self.one(["Flat {}", "Apt {}", "Apt. {}", "Unit {}", "Suite {}", "Apartment {}", "flat {}", "Floor {}", "#{}"]).format(self.one([self.digits(1), self.digits(2), self.letters(1), self.digits(1) + "B"]))
                s = f"{unit}, {s}" if self.chance(0.5) else f"{s}{self.one([', ', ' '])}{unit}"
            code = self.filled(self.one(["99999", "AA9 9AA", "AA99 9AA", "A9 9AA", "AA 99999", "99999-9999", "A9A 9A9"]))
        elif lang == "de":
            name = self.one([self.street() + x for x in ("straße", "str.", "weg", "gasse", "allee", "platz", "ring", "ufer", "damm", "steig")] + [f"{self.one(['Am', 'An der', 'Im', 'Zum', 'Auf dem', 'Alte', 'Neue'])} {self.street()}", f"{self.street()} Straße", f"{self.street()}-{self.street()}-Straße"])
            s = f"{name} {no}"
            if self.chance(0.15):
                s += self.one([", 2. OG", ", Wohnung 4", ", Hinterhaus", " Whg. 12"])
            code = self.filled(self.one(["99999", "99999", "9999", "'D-'99999"]))
        elif lang == "fr":
            s = f"{no}{self.one(['', '', '', ' bis', ' ter'])}{self.one([' ', ', '])}{self.one(STREETS['fr'])} {self.street()}"
            if self.chance(0.15):
                s = f"{self.one(['appt', 'Appt.', 'bâtiment', 'étage'])} {self.one([self.digits(1), self.letters(1)])}, {s}" if self.chance(0.5) else f"{s}, {self.one(['appt', 'apt', 'bât.'])} {self.digits(1)}"
            code = self.filled("99999")
        else:
            s = f"{self.one(STREETS['es'])} {self.street()}{self.one([', ', ' ', ', nº ', ' nº '])}{no}"
            if self.chance(0.2):
                s += self.one([", 3º B", ", piso 2", ", 1º izq.", ", 4ºA", ", bajo C", ", puerta 5"])
            code = self.filled("99999")
        x = self.r.random()
        town = self.town()
        if x < 0.35:
            return s
        if lang == "en":
            return f"{s}, {town}" if x < 0.5 else f"{s}, {town} {code}" if x < 0.8 else f"{s}, {town}, {code}" if x < 0.9 else f"{s}, {code} {town}"
        return f"{s}, {town}" if x < 0.45 else f"{s}{self.one([', ', ', ', ' - ', ' '])}{code} {town}"

    # -- what is none -----------------------------------------------------------------------------------------------

    def other(self, slot: str, lang: str) -> str:
        r, one = self.r, self.one
        y, m, d = r.randint(1990, 2035), r.randint(1, 12), r.randint(1, 28)
        if slot in CUES:
            cue = one(CUES[slot][lang] if self.chance(0.8) else CUES[slot][one(list(CUES[slot]))])
            return cue.capitalize() if self.chance(0.3) else cue
        if slot == "T":
            return one(TITLES[lang])
        if slot == "x":
            return one(THINGS)
        if slot == "D":
            month = one("January March May June August October Januar März Mai Juli Dezember janvier mars juin août enero marzo junio agosto diciembre".split())
            return one([f"{y}-{m:02}-{d:02}", f"{d:02}.{m:02}.{y}", f"{d}.{m}.", f"{d:02}/{m:02}/{y}", f"{m}/{d}/{y % 100:02}", f"{d} {month}", f"{month} {d}", f"{d}. {month} {y}", f"{d} {month} {y}", f"{y}/{m:02}/{d:02}", f"{d} de {month}", one("Monday Tuesday Friday Montag Mittwoch lundi jeudi lunes viernes".split()), f"{y}{m:02}{d:02}", f"{d}-{m:02}-{y}"])
        if slot == "H":
            h, mi = r.randint(0, 23), r.randint(0, 59)
            return one([f"{h}:{mi:02}", f"{h:02}:{mi:02}", f"{h % 12 + 1}pm", f"{h}h{mi:02}", f"{h}h", f"{h}.{mi:02}", f"{h} Uhr", f"{h:02}:{mi:02}:{r.randint(0, 59):02}", f"{h % 12 + 1}:{mi:02} am"])
        if slot == "M":
            n = r.randint(1, 9_000)
            return one([f"${n}", f"{n} €", f"€{n}.{r.randint(0, 99):02}", f"{n},{r.randint(0, 99):02} EUR", f"£{n}", f"{n} euros", f"{n:,} USD", f"{n}k"])
        if slot == "Q":
            return one([f"{self.letters(r.randint(2, 5))}-{r.randint(1, 99_999)}", f"#{r.randint(1, 99_999)}", f"T{r.randint(100, 99_999)}", f"{self.letters(3)}-{self.digits(3)}-{self.digits(4)}", f"PR {r.randint(1, 9999)}", f"issue {r.randint(1, 9999)}", f"ticket-{r.randint(1, 9999)}", f"{one(THINGS).capitalize()}-{self.digits(4)}"])
        if slot == "O" and self.chance(0.2):
            return self.id_number(lang) if self.chance(0.6) else self.filled(one(["999 999 999", "999-9999-999", "9999-9999-9999", "9999-999-999", "99-9999-9999", "999-9999", "99999 99999", "999.999.999"]))
        if slot == "O":
            return self.filled(one(["999-9999999-9999999", "'#'9999999", "'ORD-'999999", "99999999", "9999999999", "AA99999999", "'INV-'9999-9999", "9999-99999", "'PO'9999999", "999999", "AA-9999-9999", "9A99999999", "9999 9999", "'R-'999-9999", "'SO-'99999999", "99-99999", "AAA-99999-99", "999-99-99999"]))
        if slot == "V":
            a, b, c = r.randint(0, 30), r.randint(0, 60), r.randint(0, 400)
            return one([f"{a}.{b}.{c}", f"v{a}.{b}", f"v{a}.{b}.{c}", f"{a}.{b}", f"{a}.{b}.{c}-rc{r.randint(1, 9)}", f"release {a}.{b}", f"{a}.{b}.{c}.{r.randint(1, 999)}", f"{y}.{m}", f"{y}.{m:02}.{d:02}", f"{a}.{b}.{c}+{self.digits(6)}"])
        if slot == "U":
            g = re.sub(r"[^a-z]", "", one([self.given(), self.invented(2), one(THINGS)]).lower()) or "x"
            return "@" + one([g, f"{g}{self.digits(2)}", f"{g}_{one(THINGS)}", f"{g}-{one(THINGS)}", f"{g}.{self.invented(1)}", g.capitalize(), f"{g[0]}{self.invented(2)}"])
        if slot == "B":
            return one([f"{one(THINGS)}-bot", f"{one(THINGS)}bot", f"@{one(THINGS)}-bot", f"{one(THINGS)}[bot]", f"{one(THINGS).capitalize()}Bot", "the bot", f"bot-{one(THINGS)}", f"{self.given()}Bot", f"{self.given().lower()}-bot"])
        if slot == "S":
            return one([".".join(str(r.randint(1, 254)) for _ in range(4)), f"{one(THINGS)}-{r.randint(1, 40):02}", f"{one(THINGS)}.{one(THINGS)}.{one(TLDS + ['local', 'internal', 'lan'])}", f"{one(THINGS)}{r.randint(1, 40)}.{self.invented(2)}.{one(TLDS)}", f"{self.invented(2)}.{one(TLDS)}", "localhost", f"node-{r.randint(1, 99)}.{one(['local', 'internal', 'lan'])}"])
        if slot == "R":
            u, h = one([one(THINGS), self.invented(2), "root", "admin", "ubuntu", "deploy", "git", "pi", self.invented(1)]), self.other("S", lang)
            return one([f"ssh {u}@{h}", f"ssh {u}@{h}", f"ssh -p {self.digits(4)} {u}@{h}", f"scp {self.other('F', lang)} {u}@{h}:/tmp", f"{u}@{h}:~$", f"rsync -a . {u}@{h}:/srv/{one(THINGS)}", f"sftp {u}@{h}", f"git clone {u}@{h}:{one(THINGS)}.git", f"git remote add origin git@{h}:{one(THINGS)}/{one(THINGS)}.git", f"{u}@{h}:/var/{one(THINGS)}", f"mosh {u}@{h}", f"git push {u}@{h}:{one(THINGS)}", f"{u}@{h.split('.')[0]}", f"ssh://{u}@{h}:22", f"ssh -i key.pem {u}@{h}"])
        if slot == "C":
            return one({"en": MONTHS_EN, "de": MONTHS_DE, "fr": MONTHS_FR, "es": MONTHS_ES}[lang])
        if slot == "k":
            return str(r.randint(0, 10 ** r.randint(1, 6)))
        if slot == "I":
            return self.filled(one(["'978-'9-99-999999-9", "'978-'9-9999-9999-9", "'979-'99-999-9999-9", "'978'9999999999", "9-999-99999-9", "9-9999-9999-9", "'978-'9-999-99999-9", "99-9999-999-A", "999999999A"]))
        if slot == "G":
            return one([f"{r.uniform(-90, 90):.4f}, {r.uniform(-180, 180):.4f}", f"{r.uniform(0, 90):.2f} {r.uniform(0, 180):.2f}", f"{r.randint(0, 89)}°{r.randint(0, 59)}'N {r.randint(0, 179)}°{r.randint(0, 59)}'E"])
        if slot == "X":
            return one(THINGS).capitalize() if self.chance(0.5) else self.invented(2).capitalize() if self.chance(0.6) else one(["Atlas", "Apollo", "Linux", "Python", "Phoenix", "Orion", "Windows", "Titan", "Delta", "Monday", "Nova", "Java"])
        if slot == "L":
            return self.town()
        if slot == "F":
            return one([f"{one(THINGS)}.{one(['txt', 'py', 'csv', 'json', 'md'])}", f"/var/{one(THINGS)}/{one(THINGS)}.log", f"src/{one(THINGS)}/{one(THINGS)}.ts", f"C:\\{one(THINGS)}\\{one(THINGS)}.xls", f"{one(THINGS)}_{y}{m:02}{d:02}.csv"])
        if slot == "K":
            return one([str(r.randint(0, 20)), str(r.randint(20, 999)), str(r.randint(1000, 99_999)), f"{r.randint(1, 99)}.{r.randint(0, 99)}", f"{r.randint(1, 99)}%", str(r.randint(10**6, 10**10)), f"0x{r.getrandbits(32):08x}", f"{r.getrandbits(28):07x}", f"{r.getrandbits(32):08x}-{r.getrandbits(16):04x}-4{r.getrandbits(12):03x}-a{r.getrandbits(12):03x}-{r.getrandbits(48):012x}", str(r.randint(1_500_000_000, 1_900_000_000)) + one(["", "000", "123"]), f"{r.randint(1, 99)}-{r.randint(1, 99)}", f"{r.randint(1, 9)},{self.digits(3)}", f"{r.randint(1, 5)}/{r.randint(5, 9)}", f"{r.getrandbits(64):016x}"])
        raise KeyError(slot)

    # -- messages ---------------------------------------------------------------------------------------------------

    def frame(self, lang: str) -> str:
        """A slot among words of the language in no order: what it holds must be told by its form."""
        some = lambda n: " ".join(self.one(WORDS[lang]) for _ in range(self.r.randint(0, n)))
        if self.chance(0.3):  # counts, sizes and the like in a row
            unit = lambda: self.one([self.one([" ", ""]) + self.one(UNITS), "", ""])
            parts = [f"{some(2)} {self.one(['{k}' + unit(), '{k}' + unit(), '{K}' + unit(), '{O}', '{M}', '{k}.{k}' + unit()])} {some(3)}" for _ in range(self.r.randint(1, 4))]
            return re.sub(r" +", " ", self.one([", ", "; ", " ", " / ", ": "]).join(parts)).strip()
        slot = self.one(["{n}"] * 9 + ["{L}", "{X}", "{X} {x}", "{D}", "{O}", "{V}", "{Q}", "{K}", "{U}", "{S}", "{C}", "{M}", "{e}", "{p}", "{a}", "{B}", "{k}"])
        between = self.one([" "] * 6 + [", ", " (", ": ", ". "])
        return f"{some(5)}{between}{slot}{')' if between == ' (' else self.one(['', '', ',', '.', ' '])} {some(4)}".strip()

    def sentence(self, pattern: str, lang: str) -> tuple[str, list[tuple[str, int, int]]]:
        text, items = "", []
        for part in re.split(r"(\{[a-zA-Z]\}|\{\{|\}\})", pattern.replace("\\n", "\n")):
            if not re.fullmatch(r"\{[a-zA-Z]\}", part):
                text += {"{{": "{", "}}": "}"}.get(part, part)
                continue
            slot = part[1]
            kind = SLOT_KINDS.get(slot, "name" if slot == "N" else None)
            value = self.other(slot, lang) if kind is None else self.name(lang, slot == "N") if kind == "name" else getattr(self, kind)(lang)
            if kind == "name" and slot == "n" and self.chance(0.12):
                text += self.one(TITLES[lang]) + " "
            elif kind and slot in "ae" and self.chance(0.2) or kind and self.chance(0.04):
                text += self.one(LEADS)
            if kind:
                items.append((kind, len(text), len(text) + len(value)))
            text += value
        return text, items

    def changed(self, text: str, items: list, lang: str) -> tuple[str, list]:
        """Words outside of items are swapped for others now and then, so that a cue alone decides nothing."""
        cuts = [0, *[x for _, a, b in items for x in (a, b)], len(text)]
        out, moved = "", []
        for k in range(len(cuts) - 1):
            piece = text[cuts[k] : cuts[k + 1]]
            if k % 2:
                moved.append((items[k // 2][0], len(out), len(out) + len(piece)))
            elif self.chance(0.6):
                piece = re.sub(r"(?<![\w@./-])[^\W\d_]{3,}(?![\w@./-])", lambda m: m[0] if self.r.random() > 0.2 else self.one([self.invented(2), self.one(THINGS), self.one(FILLERS[lang])]), piece)
            out += piece
        return out, moved

    def message(self, patterns: dict[str, list[str]], pasted: list[str]) -> tuple[str, list[tuple[str, int, int]]]:
        lang = self.one(["en", "en", "de", "fr", "es"])
        text, items = "", []
        for k in range(self.one([1, 1, 1, 2, 2, 3])):
            x = self.r.random()
            pattern = self.one(pasted) if x < 0.15 else self.frame(lang) if x < 0.3 else self.one(patterns[lang])
            t, found = self.changed(*self.sentence(pattern, lang), lang)
            if not (found and found[0][1] == 0) and t[:1].islower() and self.chance(0.4):
                t = t[0].upper() + t[1:]
            if self.chance(0.12):
                filler = self.one(FILLERS[lang]) + self.one([", ", ": ", " ", "! ", "... "])
                filler = filler[0].upper() + filler[1:] if self.chance(0.4) else filler
                t, found = filler + t, [(c, a + len(filler), b + len(filler)) for c, a, b in found]
            if k:
                text += self.one([". ", ". ", " ", "\n", "! ", ", ", " - ", "; ", "  "])
            items += [(c, a + len(text), b + len(text)) for c, a, b in found]
            text += t
        if self.chance(0.3):
            text += self.one([".", "!", "?", " " + self.one(EMOJI), "...", " :)", ".", "  "])
        if self.chance(0.08):
            pre = self.one([self.one(EMOJI) + " ", " ", "  ", "> ", "* ", "- ", "re: "])
            text, items = pre + text, [(c, a + len(pre), b + len(pre)) for c, a, b in items]
        x = self.r.random()
        lower, upper = text.lower(), text.upper()
        if x < 0.07 and len(lower) == len(text):
            text = lower
        elif x < 0.09 and len(upper) == len(text):
            text = upper
        return text, items


def labelled(rows: int, seed: int = 5, given: list[str] | None = None, family: list[str] | None = None, part: int | None = None, parts: int = 8) -> list[tuple[str, list[tuple[str, int, int]]]]:
    """``rows`` messages with their (kind, start, end). ``part``: only the sentences of one of ``parts`` (non-negative), or all but those (~part)."""
    inside = lambda k: part is None or (k % parts == part if part >= 0 else k % parts != ~part)
    chosen = lambda s: [x for k, x in enumerate(s.strip("\n").split("\n")) if inside(k)]
    table = Table(seed, given or [], family or [])
    patterns, pasted = {k: chosen(v) + chosen(CALLED) for k, v in SENTENCES.items()}, chosen(PASTED)
    return [table.message(patterns, pasted) for _ in range(rows)]
