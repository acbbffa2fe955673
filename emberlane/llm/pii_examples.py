"""The labelled table that the field for personal data is trained from; ``[kind: ...]`` marks a span."""

EXAMPLES = """
write to [email: anna.berg@mail.example.com] for the notes
my address is [email: j_smith88@example.org], thanks
contact [email: info@shop.example.net]. We answer soon
mail [email: lee+news@example.co.uk] or come by
the user [email: root@localhost] was added
email: [email: k.muller@intern] please
send it to [email: office@post] today
reach me under [email: max@home] at night
la direction [email: paul.durand@courrier.example.fr] répond
escriba a [email: ventas@tienda.example.es] para saber
call me at [phone: (626) 555-5759] today
phone: [phone: 626-555-5759] after six
tel [phone: 212.555.0147] or by letter
our number is [phone: (319) 555-5132].
fax [phone: (415) 555-2671] and mail
mobile [phone: 873-555-4781], evenings only
you can call [phone: 606 555 7814] any time
telefon [phone: 089-555-1234] im haus
téléphone [phone: 01 55 50 12 34] le matin
teléfono [phone: 91 555 12 34] por la tarde
call [phone: +1 (724) 555-3457] now
phone [phone: +49 30 5550123] bitte
the line [phone: +33 1 55 50 11 22] is open
dial [phone: (243) 555-7962] and wait
cell [phone: 359.555.3724] works
number [phone: (733) 555-4559] in town
from host [ip: 192.168.10.4] came a reply
the server [ip: 10.0.0.17] is down
ip [ip: 89.189.210.185] was blocked
login from [ip: 39.197.112.39], twice
traffic to [ip: 23.17.61.190] stopped
l'adresse [ip: 42.100.237.47] répond
card [card: 4111111111111111] was charged
visa [card: 4012 8888 8888 1881] expires soon
credit card [card: 5555-5555-5555-4444] declined
mastercard [card: 5105105105105100] ok
carte [card: 4222.2222.2222.2] refusée
karte [card: 3782 822463 10005] gesperrt
tarjeta [card: 6011111111111117] nueva
pay with [card: 6011.0009.9013.9424] please
the old number 4111111111111112 is no card
order 4425414259157784 was shipped
parcel 4652288524086167 arrived late
invoice 2023-0045 of 12.03.2023 is due
on 2021-05-17 at 10:45 we met
the year 1998 was dry and 2003 was wet
version 2.0 of the license
version 3.11.4 came out
python 3.12.1 and spark 4.1.2 are used
chapter 12 on page 345 begins
it costs 19.99 or 1,299.00 at most
about 1000000 people and 250 dogs
room 12-14 on floor 3
from 1914-1918 and 1939-1945
model A-320 or B-52 flew
the score was 3-2 after 90 minutes
token = "0641917ea4e9feb9cda83477b57ac2654884f485" in the file
password=7602ad27cf5550de1c was set
commit be8a8e7152a5c568b612dc7f4042dd9566113270 broke it
id 555-12 and 77-3456 in the list
lot 123456 with part 98-765-43
isbn 978-3-16-148410-0 is printed
sizes 10x20 and 3.5 and 7/8
ratio 0.618 and 3.14159 and 2.718
call the doctor and phone your mother
the mail came with a visa and a card
my email server has an ip address
contact the host by telephone or fax
mail 12 letters and call 3 people
card 7 of 52 and server 4 of 9
phone 11 costs 999 dollars
meet @home and follow @news tonight
a @ b means a at b
rate 5 @ 10 each
the quick brown fox jumps over the lazy dog
It was a bright day, and the clocks struck thirteen.
Le renard brun saute par-dessus le chien.
Der Fuchs springt über den Hund; er schläft.
El zorro salta sobre el perro perezoso.
THIS IS ALL IN CAPITALS!! AND LOUD!!
word### other%%% third&&& fourth***
one | two | three | four
item-1 item-2 item-3 and item_4
x1 y2 z3 and f(x)=2x+1
99 bottles, 98 bottles, 97 bottles
1 2 3 4 5 6 7 8 9 10
12:30 13:45 23:59:59
""".strip().splitlines()
