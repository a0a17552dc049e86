"""Written by hand, by no template: texts whose marked part is personal, and texts that only look so."""

PERSONAL = (
    "Reach me under 030 12345678 any evening", "ruf mich an: 0171-1234567 bitte", "My mother was born 3 May 1985 in Leeds", "Ausweis C01X00T47 liegt bei", "He lived at 221B Baker Street for years", "Elle habite 12 rue de la Paix depuis mai",
    "my social is 123456789, keep it", "I'm jane_doe_88 on discord if you play", "mail j dot doe at example dot org please", "Call (415) 555-0134 before noon", "His number, 415-555-0199, is on the door", "tel. 0221 998 7766",
    "IBAN DE89 3704 0044 0532 0130 00 for the deposit", "SSN 078-05-1120 was printed on a card", "geboren am 12.04.1961 in Ulm", "dob 1979-11-30", "passport X4587321 expires soon", "dni B12345678 caducado",
    "write to maria[at]example[dot]net", "wohnt Lindenstraße 14 hinten", "vive en calle Mayor 23 con su hermana", "deliver to 77 Garden Road, second floor", "dm @rose_gold21 for prices", "card 4929348385146307 was declined", "my account 7712345678901 is empty",
    "nacido el 4 de julio de 1990, nacimiento: 4 de julio de 1990", "née le 14.07.1953 à Lyon", "mobile 0160 555 1234", "call me at 0711 445566", "ask @piotr99 about it",
)
OTHER = (
    "tracking code 9807915762804491", "order number 4845168114407320", "hash id 7536784127813051", "serial 1234567890123456", "invoice 8812345678123456", "@media screen and (max-width: 600px)", "the ratio was 100/200/300 at best", "blocks of 1024 2048 4096 bytes",
    "the 9 Main Street Journal of jazz", "page 120-134 of the book", "version 10.12.14 is out", "released on 2021-03-04", "the meeting of 12.05.2019", "ISBN 978-3-16-148410-0", "it costs $ 120 000 today", "a distance of 384 400 km", "model AB1234567 in red", "flight LH4521234 is late",
    "stamp 1617181920212 in the log", "use the @Override mark", "from 1998-2004 he taught", "on 3 May 1985 the bridge opened", "part number Q12X34Y56 is sold out", "ticket 0171-1234567 was closed", "room 101-204 are free", "the sum 12 24 48 doubles", "seed 123456789 gives the same run",
    "news on twitter travels fast", "stay at home dot the end", "sku 4111111111111112", "transaction id 5500000000000005", "2024/11/28 was a Thursday", "lot 99 100 101 sold", "build 20240115103000 passed", "grid 300-400-500", "rows 100000000 to 200000000",
)
