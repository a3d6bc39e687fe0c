"""Dictionaries: the built-in lists, and readers for files of the same form."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Lists that decide which names, places and offices are known.

#: First names with their forms.
FIRST_NAMES = (
    "иван", "ивана", "ивану", "иваном", "иване", "иваны", "мария", "марии", "марию", "марией", "марье", "мариям", "петр", "петра", "петру", "петром",
    "петре", "петры", "олег", "олега", "олегу", "олегом", "олеге", "олеги", "сергей", "сергея", "сергею", "сергеем", "сергее", "сергеи", "анна",
    "анны", "анне", "анну", "анной", "дмитрий", "дмитрия", "дмитрию", "дмитрием", "дмитрии", "алексей", "алексея", "алексею", "алексеем", "алексее",
    "алексеи", "наталья", "натальи", "наталье", "наталью", "натальей", "елена", "елены", "елене", "елену", "еленой", "михаил", "михаила", "михаилу",
    "михаилом", "михаиле", "михаилы", "татьяна", "татьяны", "татьяне", "татьяну", "татьяной", "андрей", "андрея", "андрею", "андреем", "андрее",
    "андреи", "ольга", "ольги", "ольге", "ольгу", "ольгой", "николай", "николая", "николаю", "николаем", "николае", "николаи", "ирина", "ирины",
    "ирине", "ирину", "ириной", "владимир", "владимира", "владимиру", "владимиром", "владимире", "владимиры", "светлана", "светланы", "светлане",
    "светлану", "светланой",
)

#: Cities.
CITIES = (
    "москва", "санкт-петербург", "новосибирск", "екатеринбург", "казань", "нижний новгород", "челябинск", "самара", "омск", "ростов-на-дону", "уфа",
    "красноярск", "воронеж", "пермь", "волгоград", "краснодар", "саратов", "тюмень", "тольятти", "ижевск", "барнаул", "ульяновск", "иркутск",
    "хабаровск", "ярославль", "владивосток", "махачкала", "томск", "оренбург", "кемерово", "новокузнецк", "рязань", "астрахань", "набережные челны",
    "пенза", "липецк", "киров", "чебоксары", "тула", "калининград", "балашиха", "курск", "севастополь", "сочи", "ставрополь", "улан-удэ", "тверь",
    "магнитогорск", "иваново", "брянск", "белгород", "сургут", "владимир", "нижний тагил", "архангельск", "чита", "калуга", "смоленск", "вологда",
    "саранск", "якутск", "курган", "орёл", "владикавказ", "подольск", "грозный", "мурманск", "тамбов", "петрозаводск", "стерлитамак", "кострома",
    "нижневартовск", "новороссийск", "йошкар-ола", "таганрог", "комсомольск-на-амуре", "сыктывкар", "нальчик", "шахты", "дзержинск", "орск", "братск",
    "энгельс", "ангарск", "благовещенск", "старый оскол", "великий новгород", "бийск", "прокопьевск", "балаково", "химки", "псков", "северодвинск",
    "балашов", "армавир", "королёв", "петропавловск-камчатский", "норильск", "сызрань", "каменск-уральский", "новочеркасск", "златоуст",
    "электросталь", "альметьевск", "салават", "миасс", "керчь", "копейск", "пятигорск", "коломна", "майкоп", "одесса", "киев", "минск", "алматы",
    "астана", "ташкент", "бишкек", "ереван", "тбилиси", "баку", "кишинев", "рига", "вильнюс", "таллин", "варшава", "прага", "берлин", "париж", "рим",
    "мадрид", "нью-йорк", "лондон", "пекин", "токио", "сеул", "дели", "стамбул", "дубай",
)

#: Countries with their forms.
COUNTRIES = (
    "россия", "российской федерации", "российская федерация", "рф", "украина", "украины", "беларусь", "белоруссии", "казахстан", "казахстана",
    "германия", "германии", "франция", "франции", "италия", "италии", "испания", "испании", "сша", "соединенных штатов", "китай", "китая", "индия",
    "индии", "бразилия", "бразилии", "армения", "армении", "грузия", "грузии", "узбекистан", "узбекистана", "таджикистан", "таджикистана", "киргизия",
    "киргизии", "молдова", "молдовы", "латвия", "латвии", "литва", "литвы", "эстония", "эстонии", "финляндия", "финляндии", "польша", "польши",
    "чехия", "чехии", "болгария", "болгарии", "сербия", "сербии", "турция", "турции", "израиль", "израиля", "япония", "японии", "корея", "кореи",
)

#: How the name of an issuing authority begins.
AUTHORITIES = (
    "уфмс", "оуфмс", "гу мвд", "умвд", "омвд", "овд", "мвд", "отделом", "отделением", "тп уфмс", "мц", "отдел", "управление", "управлением",
    "отделом по вопросам миграции", "отделением по вопросам миграции", "гувд", "увд", "увм", "овм",
)

#: Public persons, forms of a name parted by |.
PUBLIC_PERSONS = (
    "пушкин|александр сергеевич пушкин|а.с. пушкин|александр пушкин", "толстой|лев николаевич толстой|л.н. толстой|лев толстой",
    "достоевский|федор михайлович достоевский|ф.м. достоевский|федор достоевский", "чехов|антон павлович чехов|а.п. чехов|антон чехов",
    "гоголь|николай васильевич гоголь|н.в. гоголь|николай гоголь", "тургенев|иван сергеевич тургенев|и.с. тургенев|иван тургенев",
    "лермонтов|михаил юрьевич лермонтов|м.ю. лермонтов|михаил лермонтов", "есенин|сергей александрович есенин|с.а. есенин|сергей есенин",
    "маяковский|владимир владимирович маяковский|в.в. маяковский|владимир маяковский",
    "чайковский|петр ильич чайковский|п.и. чайковский|петр чайковский", "рахманинов|сергей васильевич рахманинов|с.в. рахманинов|сергей рахманинов",
    "репин|илья ефимович репин|и.е. репин|илья репин", "айвазовский|иван константинович айвазовский|и.к. айвазовский|иван айвазовский",
    "менделеев|дмитрий иванович менделеев|д.и. менделеев|дмитрий менделеев", "царевна|царевич",
)

#: The bank's offices.
BANK_OFFICES = (
    "москва ул тверская д 1", "москва ул арбат д 12", "санкт-петербург невский проспект д 28", "санкт-петербург ул садовая д 30",
    "новосибирск ул ленина д 5", "екатеринбург ул мамина-сибиряка д 36", "казань ул баумана д 20", "нижний новгород ул большая покровская д 15",
    "краснодар ул красная д 176", "ростов-на-дону ул большая садовая д 45",
)

#: The bank's phones.
BANK_PHONES = (
    "88002000000", "88005553535", "84950000000", "84951234567",
)


def parse_lines(text: str) -> list[str]:
    """Lines without blanks around them; empty ones and those that begin with # are left out."""
    return [x for line in text.splitlines() if (x := line.strip()) and not x.startswith("#")]


def parse_forms(text: str) -> list[list[str]]:
    """Lines of forms parted by |."""
    return [[f.strip() for f in line.split("|") if f.strip()] for line in parse_lines(text)]


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """A line dictionary as a table of one column, value."""
    line = F.trim("value")
    return spark.read.text(path).select(line.alias("value")).where((line != "") & ~line.startswith("#"))


def read_forms(spark: SparkSession, path: str) -> DataFrame:
    """A dictionary of forms as a table of one array column, forms."""
    return read_lines(spark, path).select(F.filter(F.transform(F.split("value", r"\|"), F.trim), lambda x: x != "").alias("forms"))
