"""The small labelled table the personal-information model is trained on.

Each line is a text with slots. ``{email}`` and the like are labelled slots, filled
by the value grammars below; ``{w}`` and ``{W}`` are invented words, ``{n}`` numbers
without a label. A line is repeated with other fillings, other letter case and other
neighbours, so that the model learns shapes and surroundings, not words.
"""

from __future__ import annotations

import random

#: Share of training lines in which an item stands among words that say nothing.
ANYWHERE = 0.4
KINDS = ("email", "phone", "idnum", "address", "name")

CARRIERS = """
Write to {email} if the upload fails.
Mail me: {email}
Mail me at {email} or call {phone}.
My address is {email}, spam-free so far.
contact <{email}> for the raw files
E-mail {email} (no attachments).
[email]{email}[/email]
<a href="mailto:{email}">{email}</a>
Schreib mir an {email} bitte.
Escríbeme a {email} y te lo paso.
Mon courriel : {email}
Manda para {email} que eu respondo.
Order: {email}
Contact {email}
{email} day and night
{email}
{email}
{phone}
{phone}
{phone} day and night
Order: {phone}
Contact {phone}
tel {phone}
Tel. {phone}
M: {phone}
☎ {phone}
mobile: {phone}
whatsapp {phone}
Call me on {phone} after six.
You can ring {phone} and ask for the archive desk.
My number is {phone}, text only.
Erreichbar unter {phone}.
Ligue para {phone}.
Llámame al {phone} por la tarde.
Mon numéro, c'est le {phone}.
My ID number is {idnum}, they wanted it for the warranty.
The shop asked for my passport no. {idnum} before shipping.
personal number {idnum} on the receipt
national id {idnum} (yes, I know)
Tax ID: {idnum}
Mi DNI es {idnum}.
Meu CPF: {idnum}
Carte d'identité n° {idnum}.
Ausweisnummer {idnum} steht auf dem Formular.
Ship to: {address}
Send the tapes to {address}.
I live at {address}, come and fetch it.
Pick-up at {address}, ring twice.
The shop moved to {address} last month.
Die Kamera steht in der {address}.
Enviadlo a {address} por favor.
Adresse : {address}
{address}
{address}
I am {name} and I collect test cards.
Me llamo {name} y soy nuevo aquí.
Je m'appelle {name}.
Ich heiße {name}.
Ich heiße {name} und suche eine Aufnahme.
Thanks to {name} for the scan.
my name is {name}
Meu nome é {name}.
Ask {name}, she repaired mine.
As Dr. {name} told us, the tape is fine.
My neighbour {name} has the same deck.
The seller is called {name}.
Signed: {name}
Regards, {name}
Thanks, {name}
{name}
{name}
{name}
{name}
{name}
""".strip().split("\n")

PLAIN = """
The server at {ip} keeps the {w} silent.
Ticket #{n5} says the {w} will be measured next week.
Ticket #{n5}-{n2} says the {w} will be measured next week.
Ticket VC-{n4} says the {w} will be cleaned next week.
Build #{n5}-{n2} on 20{n2}-0{n1}-1{n1}, log line {n2}: {w} aligned.
Build VC-{n4} on 20{n2}-1{n1}-0{n1}, log line {n2}: {w} {w}.
Checksum {hex} for the {w}, in case you want to compare.
Version {n2}.{n2} of {W} broke the {w} for me.
Version {n2}.{n2} of {brand} broke the {w} for me.
Harbour Street in the opening shot is only a painted {w}.
My {w} is dim, the {w} even more so. ({w} {w})
At {n2}:{n2} the {w} jumps and the {w} turns odd.
There is a {w} {w} in the {w} folder, {n4} x {n3} pixels.
I paid {n2} for a {w} {w} and got a {w} {w} instead. (copied)
I {w} {n2} clips last night and only the {w} went wrong.
Do not buy the {brand}, its {w} is {w}.
What does {brand} do with a {w} {w} anyway?
Thanks, that {w} {w} trick worked on {brand}!
The {w} {w} from {brand} does not like my {w}.
The {w}-{w} {w} from {W} does not like my {w}.
The {w} {w} from {brand} does not like my {w}-{w}.
Long story short: {w}, {w} and a {w}-{w} {w}.
My {w} is {w}-{w}, the {w} even more so. ({w} {w})
Finally {w} the {w}-{w} {w} and the {w} looks {w}-{w} now.
There is a {w}-{w} {w} in the {w} folder, {n4} x {n3} pixels. @{w}
Do not buy the {brand}, its {w} is {w}-{w}. ({w} {w})
What does {brand} do with a {w}-{w} {w} anyway? 🙂
The {w} {w} from {W} Reflex does not like my {w}.
Do not buy the {W} Reflex, its {w} is {w}.
Version {n2}.{n2} of {W} Reflex broke the {w} for me.
Hat jemand die {W} von {W} Reflex schon gereinigt? ({w} {W})
La {w} de {W} Reflex est trop {w}. ({w} {w})
CHEAP {brand} {w}, {n2} pieces left!!!
Meet you all in the {w} thread. ({w} {w})
Finally {w} the {w} {w} and the {w} looks {w} now.
We {w} the whole {w} twice and kept the {w} one.
Somebody {w} my {w}, or it was {w} from the start.
Long story short: {w}, {w} and a {w} {w}.
Not sure why the {w} would be {w} when the {w} is fine.
Try the {w} first, then the {w}; the order matters more than you think.
If your {w} is {w}, look at the {w} before anything else.
Same here, {w} {w} after about {n2} minutes.
Has anyone {w} a {w} without touching the {w}?
Sent from my {W}
deck: {brand}
posts: {n4}
* the tape never lies *
be kind, rewind
[size=1]no refunds[/size]
[deleted] wrote:
<deleted by moderator>
[removed]
CHEAP {W} decks, {n3} pieces left!!!
Rare {W} firmware, unlock {n3} channels
Best price for {W} only {n3} today
Visit [url=http://{host}/p{n3}]our shop[/url] now
My {w} is {w}. [url=http://{host}/t/{n4}]link[/url]
{handle} wrote:
On page {n1} {handle} wrote:
@{handle}:
Meet you all in the {w} thread. @{w}
<blockquote cite="{handle}">
[quote={handle}]
[/quote]
{w}
--
~~~~
The {w} {w} of {W} while {w} and {w} {w} the {w} {w}
{w} and {w} {w} whenever a {w} stores the {w} {n3} {w} {w} the {w} {w} of {W} {W} counts two {w} {w}
Before a {w} paints the {w}; {W} repairs twelve {w} {w} although {w} measures {W} counts three {w} {w}
Anyone know the answer? {W} and {w} weighs {W} borrows {n3} {w} {w} until a {w} sends the {w}
Q: Where a {w} carries the {w} the {w} {w} of {W} unless {w} carries; While {w} and {w} keeps
Found this in a pack: {W} and {w} gathers {w} {n3} {w} {w} but {W} {W} divides the {w} {w} of {w} {w} the
because a {w} counts the {w} {w} and {w} of the {W} a {w} {w} so {W} keeps {n3} {w}
{w} the of and {w} {W} {w}; {w} a {W} {w} {w} {w} the a {n3} {W} {w} {W} {w}
{w} {w}. Before {w} divides
measures. {W} trades seven {w} {w}
{w} of {W} {w} and {w}
lantern of {W} {W} counts thirty
{W} {W} borrows twelve
sends eleven winding {w} {W} counts
although {w} measures {n3} {w} {w}
divides the {w} {W} trades eight (copied)
{w} of {W} {W} gathers
{w} {w} (copied)
{w} {w}s whenever
{w} {w}s.
{w} {w}s while a
{w} {w}s (copied)
{w} {w}s the {w}
{w} {w}s. Before {w} divides
{w}. Where
{w} counts
of {W}. {W} and {w} divides
La {w} de {brand} es demasiado {w}. ({w} {w})
No entiendo por qué la {w} sale {w}.
Probad primero la {w} y luego la {w}.
¿Alguien ha {w} una {w} {w}?
Ayer he {w} la {w} y la {w} sigue {w}.
Después de {n2} minutos la {w} se queda {w}.
Gracias, con la {w} {w} ya funciona.
Danke, die {W} läuft über {brand} wieder.
Hat jemand die {W} von {brand} schon getauscht?
Nach {n2} Minuten wird die {W} schief.
Die {W} ist dunkel, aber die {W} nicht.
Ohne die {W} geht bei mir gar nichts. ({w} {W})
Gestern habe ich die {W} {w}, jetzt ist die {W} {w}.
La {w} de {brand} est trop {w}.
Merci, avec la {w} {w} ça marche.
Au bout de {n2} minutes la {w} devient {w}.
Je ne comprends pas pourquoi la {w} est {w}.
Hier j'ai {w} la {w} et la {w} reste {w}.
Quelqu'un a déjà {w} une {w} {w} ?
A {w} da {brand} é muito {w}. @{w}
Depois de {n2} minutos a {w} fica {w}.
Ontem tinha {w} a {w} e a {w} continua {w}.
Alguém já tem {w} a {w} {w}?
Obrigado, com a {w} {w} funcionou.
""".strip().split("\n")

# Sentences of everyday letters, notices and messages, in no relation to any corpus.
GENERAL = """
You can reach {name} on {phone} or at {email}.
Please ask for {name} at the front desk.
{name} will meet you at the station at noon.
We spoke with {name} about the contract yesterday.
Dear {name}, thank you for your letter of 12 March.
The report was written by {name} and {name}.
Invoices go to {name}, {address}.
For questions contact {name} ({email}).
In an emergency dial {phone} and wait for the tone.
Our office has moved to {address}.
The parcel was delivered to {address} on Friday.
Her new address is {address}.
She was born in 1984 and holds passport {idnum}.
The applicant, {name}, gave the number {idnum} as proof.
Social security number: {idnum}
Insurance no. {idnum}, valid until 2027
Reply to {email} before Monday.
I have copied {email} on this message.
Forward it to {email} and {email}.
Phone: {phone}, fax: {phone}
Name: {name}
Address: {address}
Best wishes, {name}
Yours sincerely, {name}
Mr. {name} signed the lease in May.
According to Mrs {name} the meeting is cancelled.
Professor {name} teaches history on Tuesdays.
{name} has lived at {address} since 2003.
When I called {phone} nobody answered.
Send a text to {phone} when you arrive.
The winner is {name} from the second year.
My brother, {name}, works there too.
Yesterday {name} and I went to the lake.
It was {name} who found the keys.
Did you know that {name} plays the violin?
The package for {name} is still at {address}.
Have you heard from {name} lately?
Best, {name} / {email} / {phone}
Puede llamar a {name} al {phone}.
El informe lo firmó {name} el lunes.
Mi hermana {name} vive en {address}.
La oficina está en {address}.
Mi correo es {email} y mi teléfono {phone}.
El pasaporte {idnum} está caducado.
Estimada {name}: le escribo por la factura.
Don {name} no estaba en casa ayer.
Pregunte por {name} en la recepción.
Un saludo, {name}
Ayer {name} me llamó desde {phone}.
El NIF del cliente es {idnum}.
Contacte con {name} escribiendo a {email}.
Bitte rufen Sie {name} unter {phone} an.
Frau {name} wohnt in der {address}.
Das Paket ging an {name}, {address}.
Unsere neue Anschrift lautet {address}.
Meine E-Mail-Adresse ist {email}.
Der Pass mit der Nummer {idnum} ist abgelaufen.
Sehr geehrter Herr {name}, vielen Dank für Ihr Schreiben.
Gestern hat {name} den Vertrag unterschrieben.
Fragen Sie am Eingang nach {name}.
Mit freundlichen Grüßen {name}
Ich habe mit {name} über das Haus gesprochen.
Die Steuernummer lautet {idnum}.
Mein Bruder {name} arbeitet auch dort.
Vous pouvez joindre {name} au {phone}.
Madame {name} habite au {address}.
Notre bureau se trouve {address}.
Le colis a été livré à {name}, {address}.
Mon adresse électronique est {email}.
Le passeport {idnum} est périmé.
Cher {name}, merci pour votre lettre.
Hier {name} a signé le contrat.
Demandez {name} à l'accueil.
Cordialement, {name}
J'ai parlé avec {name} de la maison.
Numéro de sécurité sociale : {idnum}
Mon frère {name} travaille aussi là-bas.
Pode ligar para {name} no {phone}.
A senhora {name} mora na {address}.
O nosso escritório fica na {address}.
O pacote foi entregue a {name}, {address}.
O meu e-mail é {email}.
O passaporte {idnum} já não é válido.
Caro {name}, obrigado pela sua carta.
Ontem {name} assinou o contrato.
Pergunte por {name} na entrada.
Atenciosamente, {name}
Falei com {name} sobre a casa.
O número de contribuinte é {idnum}.
O meu irmão {name} também trabalha lá.
We had dinner with {name} last night.
This is a present from {name} for the children.
The bridge is named after {name}.
Everything depends on {name} now.
Our teacher {name} often tells that story.
My aunt {name} bakes on Sundays.
I borrowed a ladder from {name} this morning.
There was a note for {name}, nothing else.
She is married to {name} and works in a bank.
Nobody but {name} knew the code.
{name} drew the map on page 12.
{name} opened the door and laughed.
Give my regards to {name} when you see her.
He sold the house to {name} for a song.
The judge, {name}, listened carefully.
Let {name} know that I will be late.
Cenamos con {name} anoche.
Es un regalo de {name} para los niños.
Mi tía {name} cocina muy bien.
El cuadro lo pintó {name} en el sur.
{name} abrió la puerta y se rio.
Se casó con {name} en otoño.
La calle lleva el nombre de {name}.
Le presté la escalera a {name} esta mañana.
El abogado se llama {name} y trabaja cerca.
Dale recuerdos a {name} de mi parte.
Gestern waren wir mit {name} essen.
Das ist ein Geschenk von {name} für die Kinder.
Meine Tante {name} kocht sehr gut.
Unser Lehrer {name} erzählt das oft.
Das Bild ist von {name} gemalt.
Den Brief hat {name} geschrieben.
{name} öffnete die Tür und lachte.
Der Anwalt heißt {name} und arbeitet hier.
Die Brücke ist nach {name} benannt.
Grüß {name} von mir.
Das Fahrrad gehört {name} aus dem Erdgeschoss.
Nous avons dîné avec {name} hier soir.
C'est un cadeau de {name} pour les enfants.
Ma tante {name} cuisine très bien.
Le tableau est peint par {name} dans le sud.
{name} ouvrit la porte et rit.
L'avocat s'appelle {name} et travaille ici.
La rue porte le nom de {name}.
J'ai prêté l'échelle à {name} ce matin.
Le vélo est à {name} du premier étage.
Passe le bonjour à {name} de ma part.
Jantámos com {name} ontem à noite.
É um presente de {name} para as crianças.
A minha tia {name} cozinha muito bem.
O quadro foi pintado por {name} no sul.
{name} abriu a porta e riu.
O advogado chama-se {name} e trabalha aqui.
A rua tem o nome de {name}.
Emprestei a escada a {name} esta manhã.
Dá cumprimentos a {name} da minha parte.
Quem escreveu a carta foi {name}.
""".strip().split("\n")

GENERAL_PLAIN = """
The train to New York leaves on Sunday Morning at 10:45.
We watched Star Wars and then went for a walk in Hyde Park.
In South Korea the new phone costs 899 dollars.
Great Britain and Northern Ireland voted on Thursday.
Chapter 12 of the manual explains the Power Button.
My order 4471920 arrived two days late.
Windows Vista was released on 30 January 2007.
The meeting is on 2024-11-05 at 14:30 in Room 204.
Call me when you can, I am at home all day.
Nobody was at the station when the last bus came.
The invoice total is 1,249.50 euros, due in 30 days.
He lives in a small house near the river with two dogs.
Please read the Terms of Service before you install it.
Pages 101-118 were missing from the Second Edition.
I have been waiting for three weeks and still no answer.
The Red Cross and the United Nations sent help.
Flight 2231 from San Francisco was cancelled.
El Museo del Prado abre los lunes a las 10.
La semana pasada fuimos a Costa Rica con los niños.
El pedido 5521877 llegó con dos días de retraso.
No hay nadie en la oficina los viernes por la tarde.
La factura asciende a 349,90 euros.
Los Estados Unidos y la Unión Europea firmaron el acuerdo.
Der Zug nach Bad Homburg fährt am Montag um 8:15 Uhr.
Die Deutsche Bahn hat den Fahrplan im Dezember geändert.
Die Rechnung beträgt 349,90 Euro und ist sofort fällig.
Am Freitag ist das Büro ab 14 Uhr geschlossen.
Die Europäische Union und die Vereinigten Staaten haben verhandelt.
Das Handbuch der Digitalen Kamera hat 212 Seiten.
Le train pour Saint Malo part dimanche à 9 h 20.
La facture s'élève à 349,90 euros.
La Tour Eiffel est fermée le mardi.
Les États Unis et l'Union Européenne ont signé.
Personne n'est au bureau le vendredi après-midi.
O comboio para Vila Real parte no domingo às 9h20.
A fatura é de 349,90 euros.
Os Estados Unidos e a União Europeia assinaram.
Ninguém está no escritório na sexta à tarde.
O Rio de Janeiro fica longe daqui.
Thank you for your patience, the Support Team will answer soon.
The Lord of the Rings is my favourite book by far.
A slow trailer, a watermark and some flicker are all I see.
Watermark, flicker, trailer, scan: every copy has one of them.
""".strip().split("\n")

# Given names and surnames that many people bear in the five languages; towns and streets that many know.
GIVEN = (
    "James John Robert Michael William David Richard Thomas Charles Daniel Matthew Anthony Mark Steven Stephen Andrew Paul George Kevin Brian Edward Peter Mary Patricia Jennifer Linda Elizabeth Susan Jessica Sarah Karen Nancy Lisa Margaret Emily Helen Alice Rebecca Laura Emma Olivia Grace "
    "Antonio José Manuel Francisco Juan Javier Carlos Miguel Alejandro Rafael Pedro Pablo Sergio Fernando Luis Andrés Diego María Carmen Ana Isabel Dolores Pilar Teresa Rosa Lucía Marta Elena Cristina Raquel Beatriz Sofía Inés "
    "Hans Peter Wolfgang Klaus Jürgen Dieter Manfred Uwe Jens Stefan Andreas Markus Lukas Felix Jonas Ursula Monika Petra Sabine Renate Helga Karin Brigitte Ingrid Anna Claudia Susanne Heike Julia Katharina Lena "
    "Jean Pierre Michel Philippe Alain Jacques Bernard Nicolas Laurent Olivier François Julien Antoine Luc Marie Nathalie Isabelle Sylvie Catherine Claire Camille Sophie Céline Amélie Chloé Manon "
    "João Rui Nuno Tiago Paulo Jorge Ricardo Bruno Luís Hugo Helena Sandra Catarina Joana Rita Paula Margarida Fernanda Mariana"
).split()
SURNAMES = "Smith Jones Brown Taylor Wilson Keller Müller Schmidt Becker Hoffmann Weber Schulz Dubois Martin Bernard Moreau Lefèvre Girard García López Fernández Moreno Ruiz Torres Silva Santos Pereira Costa Almeida Carvalho Khan Tanaka Chen Novak Ivanova Rossi Murphy O'Brien McDonald Johnson Walker Hughes".split()
TOWNS = "London,Paris,Berlin,Madrid,Lisboa,Porto,München,Köln,Lyon,Sevilla,Bristol,Leeds,Boston,Chicago,São Paulo,Bad Homburg,New York,Saint Denis,Buenos Aires".split(",")
STREETS = "Baker,High,Station,Church,Mill,Victoria,Oxford,Garden,Oak,Maple,Park,King".split(",")


_ONSET = "b br d dr f fr g gl gr h j k kl kr l m n p pr pl r s sk sl sm sp st str t tr v vr w z".split()
_VOWEL = "a e i o u ae ia ai ei io ou".split()
_CODA = ["", *"d g k l lt m n nd r rk rt s sk st t v x z p b".split()]
_SURNAME_END = "mark sen stad ov ez berg ly é".split()
_PLACE_END = "ton burg haven ville sund moor field vale ham".split()


class Filler:
    """Fills slots with invented values."""

    def __init__(self, rng: random.Random):
        self.rng = rng
        #: Whether names and towns are common ones instead of invented ones.
        self.known = False

    def word(self, low: int = 1, high: int = 3) -> str:
        c = self.rng.choice
        return "".join(c(_ONSET) + c(_VOWEL) + c(_CODA) for _ in range(self.rng.choice([low] * 2 + list(range(low, high + 1)))))

    def digits(self, n: int) -> str:
        return "".join(self.rng.choice("0123456789") for _ in range(n))

    def given(self) -> str:
        return self.rng.choice(GIVEN) if self.known else self.word(1, 2).capitalize()

    def surname(self) -> str:
        if self.known and self.rng.random() < 0.8:
            return self.rng.choice(SURNAMES)
        r = self.rng.random()
        base = self.word(1, 2)
        one = (base + self.rng.choice(_SURNAME_END) if r < 0.75 else base).capitalize()
        r = self.rng.random()
        if r < 0.07:
            return self.rng.choice(["van", "von", "van", "von", "de", "di"]) + " " + one
        if r < 0.12:
            return "al-" + one
        if r < 0.18:
            return "O'" + one
        if r < 0.26:
            return one + "-" + self.surname().split(" ")[-1]
        return one

    def name(self) -> str:
        g, s = self.given(), self.surname()
        r = self.rng.random()
        if r < 0.5:
            out = f"{g} {s}"
        elif r < 0.62:
            out = f"{g[0]}. {s}"
        elif r < 0.72:
            out = f"{s}, {g}"
        elif r < 0.76:
            out = f"{s}, {g} " + self.rng.choice([self.given(), self.given()[0] + ".", self.given()[0]])
        elif r < 0.84:
            out = f"{g} {self.given()} {s}"
        elif r < 0.92:
            out = f"{g} {self.given()[0]}. {s}"
        else:
            out = f"{s} {g}"
        r = self.rng.random()
        return out.upper() if r < 0.12 else out.lower() if r < 0.3 else out

    def host(self) -> str:
        if self.known:
            return self.word(1, 3) + self.rng.choice(["", "mail", "-group", ".co"]) + "." + self.rng.choice("com org net de fr es pt uk example".split())
        a = self.rng.choice(["", "", "", "post.", "mail.", "lists."])
        return a + self.word(1, 3) + self.rng.choice(["", "", "net", "post", "-mail"]) + "." + self.rng.choice(["example", "test", "invalid", "example"])

    def email(self) -> str:
        g, s, n = self.word(1, 2), self.word(1, 2), self.rng.choice(["", self.digits(1), self.digits(2), self.digits(3)])
        if self.known:
            g, s = (self.rng.choice(x).lower().replace("'", "") for x in (GIVEN, SURNAMES))
        user = self.rng.choice([f"{g}.{s}", g, f"{g}{n}", f"{g}_{s}{n}", f"{g}{n}", f"{g}+video", f"{g}-{s[:3]}", f"{g[0]}{s}mark"])
        host = self.host()
        r = self.rng.random()
        if r < 0.5:
            out = f"{user}@{host}"
        elif r < 0.62:
            out = f"{user} @ {host}"
        elif r < 0.66 and self.known:
            out = f"{user} at {host.replace('.', ' dot ')}"
        elif r < 0.72:
            out = f"{user} (at) {host.replace('.', ' (dot) ')}"
        elif r < 0.8:
            out = f"{user} [at] {host}"
        elif r < 0.92:
            out = f"{user} AT {host.replace('.', ' DOT ')}"
        else:
            out = f"{user}&#64;{host}"
        return out.upper() if self.rng.random() < 0.06 else out

    def phone(self) -> str:
        d = self.digits
        forms = [
            f"+999 (0){d(3)} / {d(3)} {d(3)}", f"+999{d(9)}", f"+999-{d(2)}-{d(3)}-{d(4)}", f"+999 {d(2)} 555 {d(4)}", f"00999 {d(3)} {d(6)}", f"555-01{d(2)}-{d(3)}",
            f"(555) 01{d(1)}-{d(4)}", f"06.39.98.{d(2)}.{d(2)}", f"0{d(1)} {d(2)} {d(2)} {d(2)} {d(2)}", f"07700 {d(6)}", f"01632-{d(6)}", f"07700/{d(6)}",
        ]
        known = [
            f"+44 20 {d(4)} {d(4)}", f"(212) 555-{d(4)}", f"+1 415 555 {d(4)}", f"+49 {d(2)} {d(6)}", f"030 {d(8)}", f"0{d(3)}-{d(6)}", f"+33 1 {d(2)} {d(2)} {d(2)} {d(2)}", f"+34 9{d(1)} {d(3)} {d(2)} {d(2)}", f"6{d(2)} {d(3)} {d(3)}", f"+55 11 9{d(4)}-{d(4)}", f"9{d(2)} {d(3)} {d(3)}",
            f"020 {d(4)} {d(4)}", f"{d(3)}-{d(3)}-{d(4)}", f"{d(3)}.{d(3)}.{d(4)}",
        ]
        return self.rng.choice(known if self.known else forms)

    def idnum(self) -> str:
        d, c = self.digits, lambda: self.rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZ")
        return self.rng.choice([d(8) + " " + c(), d(8) + "-" + c(), d(8) + c(), f"{d(6)}-{d(4)}", c() + c() + d(7), f"000-{d(2)}-{d(4)}", f"{d(2)} {d(6)} {c()}{d(3)}", f"{d(3)}.{d(3)}.{d(3)}-{d(2)}"])

    def town(self) -> str:
        if self.known and self.rng.random() < 0.7:
            return self.rng.choice(TOWNS)
        return (self.word(1, 2) + self.rng.choice(["", "", *_PLACE_END])).capitalize()

    def address(self) -> str:
        d, c, w = self.digits, self.rng.choice, self.word(1, 2).capitalize()
        n = str(self.rng.randrange(1, 240))
        suffix = c(["", "", "a", "b", "c"])
        forms = [
            f"{w}straße {n}{suffix}, {d(5)} {self.town()}", f"{w}weg {n}{suffix}, {d(5)} {self.town()}", f"{n}{suffix} {w} Close, {self.town()}",
            f"{n} {w} {c(['Road', 'Lane', 'Ave', 'St.'])}, {self.town()} {d(5)}", f"Flat {d(1)}{c(['', d(1)])}, {n} {w} Road, {self.town()}, {c('PKMNL')}{c(['', d(1)])}{d(1)} {d(1)}{c('QXZ')}{c('QXZ')}",
            f"Calle {w} {n}, {d(1)}º, {d(5)} {self.town()}", f"{n} rue {w}, {d(5)} {self.town()}", f"Rua {w}, {n}, {d(4)}-{d(3)} {self.town()}",
        ]
        if self.known:
            street, person = c([*STREETS, w]), c(SURNAMES)
            forms += [
                f"{n}{suffix} {street} {c(['Street', 'Road', 'Avenue', 'Lane', 'Drive', 'Square', 'St'])}, {self.town()}", f"{n} {street} {c(['Street', 'Road', 'Avenue'])}, {self.town()}, {c('NSEW')}{c('WMC')}{d(1)} {d(1)}{c('ABDE')}{c('XHTQ')}", f"{n} {street} Avenue, {self.town()}, {c(['NY', 'MA', 'CA', 'IL'])} {d(5)}",
                f"{n} rue {c(['de la', 'du', 'des', 'de'])} {w}, {d(5)} {self.town()}", f"{n}, avenue {person}, {d(5)} {self.town()}", f"{n} boulevard {person}, {d(5)} {self.town()}", f"Calle de {c(['la', 'los', ''])} {w} {n}, {d(5)} {self.town()}".replace("  ", " "), f"Avenida {person} {n}, {d(5)} {self.town()}",
                f"Rua {c(['da', 'do', 'das'])} {w} {n}, {d(4)}-{d(3)} {self.town()}", f"Av. {person}, {n}, {self.town()}", f"{c([person, w])}straße {n}, {d(5)} {self.town()}", f"{c(['Haupt', 'Bahnhof', 'Garten', w])}str. {n}{suffix}, {d(5)} {self.town()}", f"{c(['Alte', 'Neue', 'Lange'])} {c(['Gasse', 'Allee', 'Straße'])} {n}, {d(5)} {self.town()}",
            ]
        out = c(forms)
        return out.upper() if self.rng.random() < 0.05 else out

    def slot(self, name: str) -> str:
        if name in KINDS:
            return getattr(self, name)()
        if name[0] == "n":
            return self.digits(int(name[1:]))
        if name == "w":
            return self.word(1, 3)
        if name == "W":
            return self.word(1, 3).capitalize()
        if name == "brand":
            return self.word(1, 3).capitalize() + self.rng.choice(["", "", "-X", " Reflex", " " + self.digits(1), " " + self.digits(2)])
        if name == "ip":
            return f"192.0.2.{self.rng.randrange(1, 99)}"
        if name == "hex":
            return "".join(self.rng.choice("0123456789abcdef") for _ in range(16))
        if name == "host":
            return self.host()
        if name == "handle":
            return self.word(1, 2) + self.rng.choice(["", "x", "_tv", self.digits(2)]) + "." + self.digits(self.rng.choice([1, 2, 3]))
        raise KeyError(name)


# Short words of the five languages that stand around items.
FUNCTION_WORDS = [
    "the a an of to in for with on at from by and or but is was are has had will not even only this that our my her his their who when if after before under near please two".split(),
    "el la los las un una de del al a en con por para y o pero es era ha había no ni este esta nuestro mi su quien cuando si antes después cerca hay dos".split(),
    "der die das den dem ein eine einen von zu im in mit für auf an bei aus und oder aber ist war hat hatte nicht nur dieser unser mein ihr wer wenn nach vor unter zwei bitte".split(),
    "le la les un une de du des au à en avec par pour et ou mais est était a avait ne pas ce cette notre mon sa qui quand si avant après près chez deux".split(),
    "o a os as um uma de do da ao em no na com por para e ou mas é era tem tinha não nem este esta nosso meu sua quem quando se antes depois perto há dois".split(),
]


def _anywhere(fill: Filler) -> str:
    """A sentence of short words of one language and unknown longer ones, with one item in the middle or at an end."""
    c, german = fill.rng.choice, fill.rng.random() < 0.2
    short = FUNCTION_WORDS[2] if german else c(FUNCTION_WORDS)

    def stretch(most: int) -> list[str]:
        made = []
        for _ in range(fill.rng.randrange(most + 1)):
            w = c(short) if fill.rng.random() < 0.55 else fill.word(1, 3)
            made.append(w.capitalize() if german and w not in short and fill.rng.random() < 0.5 else w)
        return made

    slot = "{" + c(["name"] * 7 + ["address"] * 2 + ["phone", "email", "idnum"]) + "}"
    before, after = stretch(6), stretch(6)
    if before:
        before[0] = before[0].capitalize()
    if not before and not after:
        after = [c(short), fill.word(1, 2)]
    out = " ".join([*before, slot, *after])
    return out + c([".", ".", ".", "", "!", "?"])


def _unfamiliar(pattern: str, fill: Filler) -> str:
    """The sentence with half of its longer words unknown ones of the same look; pairs of capitals stay."""
    words = pattern.split(" ")
    capital = [w[:1].isupper() for w in words]
    for i, w in enumerate(words):
        pair = capital[i] and (i > 0 and capital[i - 1] or i + 1 < len(words) and capital[i + 1])
        if len(w) > 3 and w.isalpha() and not pair and fill.rng.random() < 0.5:
            made = fill.word(1, 3)
            words[i] = made.capitalize() if capital[i] else made
    return " ".join(words)


def labelled_lines(count: int = 6000, seed: int = 11) -> list[tuple[str, list[tuple[int, int, str]], bool]]:
    """(text, spans of (start, end, kind), whether it stands under a signature mark)."""
    rng = random.Random(seed)
    fill = Filler(rng)
    out = []

    def make(pattern: str) -> tuple[str, list[tuple[int, int, str]]]:
        text, spans, at = "", [], 0
        while (k := pattern.find("{", at)) >= 0:
            end = pattern.index("}", k)
            text += pattern[at:k]
            name = pattern[k + 1 : end]
            value = fill.slot(name)
            if name in KINDS:
                spans.append((len(text), len(text) + len(value), name))
            text += value
            at = end + 1
        return text + pattern[at:], spans

    def add(text: str, spans: list, more: str, gap: str = " ") -> tuple[str, list]:
        extra, others = make(more)
        base = len(text) + len(gap)
        return text + gap + extra, spans + [(a + base, b + base, k) for a, b, k in others]

    patterns = [p for p in CARRIERS for _ in range(2)] + PLAIN + GENERAL + GENERAL_PLAIN
    general = len(patterns) - len(GENERAL) - len(GENERAL_PLAIN)
    for i in range(count):
        pattern = patterns[i % len(patterns)]
        fill.known = i % len(patterns) >= general or rng.random() < 0.15
        if rng.random() < ANYWHERE:
            pattern, fill.known = _anywhere(fill), rng.random() < 0.6
        elif i % len(patterns) >= general and rng.random() < 0.7:
            pattern = _unfamiliar(pattern, fill)
        lead = rng.random()
        text, spans = make(rng.choice(PLAIN)) if lead < 0.12 else ("", [])
        text, spans = add(text, spans, pattern, " " if text else "")
        alone = bool(spans) and pattern.startswith("{")
        signed = rng.random() < (0.6 if alone else 0.08)
        if spans and rng.random() < 0.15:
            kind = rng.choice(["{phone}", "{email}"])
            text, spans = add(text, spans, kind, rng.choice([" / ", ", also ", " or "]))
        if rng.random() < (0.25 if not alone else 0.04):
            text, spans = add(text, spans, rng.choice(PLAIN))
        r = rng.random()
        if r < 0.05:
            text += rng.choice([" :)", " ^^", " 🙂", "&nbsp;"])
        elif r < 0.1:
            text, spans = add(text, spans, "({w} {w})")
        elif r < 0.2:
            text += rng.choice(["<br>", "<br />"])
        r = rng.random()
        if r < 0.09:
            text = text.upper() if len(text.upper()) == len(text) else text
        elif r < 0.13:
            text = text.lower() if len(text.lower()) == len(text) else text
        front = rng.choice([""] * 12 + ["> ", "| ", ">", "> > ", "<b>", "[i]", "<p>", "&gt; "])
        out.append((front + text, [(a + len(front), b + len(front), k) for a, b, k in spans], signed))
    return out
