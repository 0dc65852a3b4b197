"""Messages written by hand for the test only: none of their wordings, names or numbers is in the labelled table. Items stand as [kind:text]."""

MESSAGES = """
Yesterday [name:Deepika Subramaniam] drove me to the airport.
Happy anniversary [name:Jennifer] and [name:Oluwaseun Adeyemi]!!
The landlord is [name:Tomasz Wiśniewski]; his mobile: [phone:+48 601 234 567].
can someone forward the slides to [email:marketing@fabrikam.io]?
I phoned from [phone:020 7946 0321] but the line was dead
Her SSN is [id_number:219-09-9999], don't write it on the form.
Passport [id_number:K8812345] was stamped in Lisbon
Mein Kollege [name:Matthias Brandstätter] sitzt jetzt in der [address:Lindengasse 7, 1070 Wien].
Könntest du bitte [name:Svenja] Bescheid geben?
Frau Dr. [name:Hagedorn] ist ab Montag wieder da.
Meine neue Nummer lautet [phone:0171 5558812], die alte gilt nicht mehr
Monsieur [name:Desrosiers] a laissé un message : [phone:06 39 98 41 22]
On se retrouve chez [name:Mathilde], [address:14 rue Mouffetard, 75005 Paris]
Envoyez le devis à [email:compta@atelier-nord.fr] avant vendredi
La directora, [name:Guadalupe Zamora], firmará el acta mañana.
Mi nuevo domicilio es [address:Calle Serrano 45, 28001 Madrid]
El NIE de mi marido es [id_number:Y2345678B]
Llama a [name:Rubén] al [phone:612 345 678] cuando llegues
[name:J. Halloran] signed for the crate at 9:40.
Ship it to [address:742 Evergreen Terrace, Springfield] please, signature needed
The clinic moved to [address:Unit 9, 58 Harbour Road, Bristol BS1 4ND].
our accountant ([name:Nkechi Obi]) wants receipts by 30 June
you may also try [email:first.last+books@mail.example.co.uk] or [email:k_larsen at nordlys dot no]
For refunds dial [phone:1-800-555-0147]
driver: [name:Mehmet Yıldız], licence [id_number:YILDI701015M99]
Ticket BUG-4412 is a duplicate of BUG-4398.
Release 3.14.2 rolled out to 40% of hosts at 02:15 UTC
ssh ops@10.20.30.40 and restart nginx
git clone git@code.example.org:infra/tools.git
Build 20260114.3 is green, deploying 2.8.0-rc1
@kittenmittens can you rebase?
dependabot[bot] opened a pull request
Order 4411-90233 left the warehouse on 12/03/2026
The Berlin office closes early in December.
May I take Friday off? April was hectic.
The total is 1,204.50 EUR for 3 nights
Kernel 6.8.0-45 panics on node-17.rack4.internal
Die Sitzung am Donnerstag fällt leider aus
Le serveur de recette est en panne depuis lundi
El tren sale a las 18:45 del andén 3
sha256 9f86d081884c7d659a2feaa0c55ad015 does not match
psql -h db01 -U reporting -p 5432
Meeting id 882 1234 5678, passcode 771204
"""


def messages() -> list[tuple[str, list[tuple[str, int, int]]]]:
    import re

    out = []
    for line in MESSAGES.strip().split("\n"):
        text, items = "", []
        for part in re.split(r"(\[[a-z_]+:[^\]]*\])", line):
            m = re.fullmatch(r"\[([a-z_]+):([^\]]*)\]", part)
            if m:
                items.append((m[1], len(text), len(text) + len(m[2])))
            text += m[2] if m else part
        out.append((text, items))
    return out
