"""URL filters: host and path rules, then logistic regression on hashed character n-grams.

Rules are judged with column functions.  Urls that no rule fits, and they alone, get the verdict of a
logistic regression whose features are the character n-grams of host and path, hashed into
2 ** ``BITS`` weights; it is fitted by full-batch gradient steps on ``LABELLED``, a small table
written here from common knowledge of such sites, and always gives the same weights.

Nulls and edges: a null url, or one without ``://``, has empty host and path, fits no rule
and is judged by the model's intercept; an empty path fits no rule, since all rules' paths
begin with ``/``; of rules that fit, the one of the longest host and path wins, and of
equally long ones the first listed; repeated rows are judged each; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fabulagraph.llm import hashing

#: Fixed values of the contract: (verdict, host and path).
RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))

BITS = 14
SIZES = (3, 4, 5)
#: Characters judged at once, or one url.
CHUNK = 1 << 20

#: The labelled urls that the model is fitted on.
BLOCKED = """
luckycasino.com/slots  vegas-casino-games.com/play  onlinecasino24.de/bonus  grand-jackpot.com/spin  mobile-slots.co.uk/free-spins  roulette-king.com/tables
poker-room.com/holdem  www.playpoker.com/tournament  betting-tips.com/odds  sportsbet.com.au/football  bet-on-football.com/live  www.bookmaker-odds.co.uk/horses
bingo-hall.co.uk/rooms  lotto-results-win.com/claim-prize  bigwinlottery.com/ticket  blackjack-pro.com/strategy/deposit  gambling-bonus.com/no-deposit  freebet.com/signup
adultfriend.com/meet  adult-movies.com/watch  xxxvideos.com/clip/1  free-xxx.net/gallery  pornstars.com/models  best-porn-site.com/hd  sexcams.com/live  hotsex.com/pics
nude-girls.com/photos  webcam-sex.net/room/7  escorts-london.co.uk/tonight  erotic-massage.com/city  milf-dating.com/chat  swingers-club.com/join  fetish-world.com/tube
cheapviagra.com/order  buy-cialis-online.com/pills  canadian-pharmacy.com/rx  onlinepills.net/no-prescription  generic-meds.com/viagra  weight-loss-pills.com/buy  steroids-shop.com/order
payday-loan.com/apply-now  quick-loans.co.uk/cash  bad-credit-loans.com/instant  fast-cash-advance.com/apply  debt-relief-now.com/offer  make-money-online.com/secret
earn-cash-fast.com/click  bitcoin-doubler.com/invest  crypto-profit.com/guaranteed  forex-signals-win.com/vip  get-rich.com/system  work-from-home-cash.com/join
replica-rolex.com/watches  fake-watches.com/shop  cheap-handbags-replica.com/sale  cheap-jerseys.com/outlet  discount-ugg-outlet.com/cheap
buybacklinks.com/seo  seo-link-farm.com/links  link-exchange.com/submit  spam-comments.com/tool  mass-mailer.com/spam  buy-instagram-likes.com/followers  traffic-bot.com/visitors
warez-download.com/crack  keygen.com/serial  cracked-software.com/free-download  torrentz.com/movie  pirate-movies.com/stream  nulled-scripts.com/download  free-mp3-warez.com/album
login-verify-account.com/paypal  secure-update-bank.com/login  account-suspended.com/verify  apple-id-locked.com/confirm  phish-kit.com/page  malware-site.com/payload.exe
virus-alert.com/fix-now  free-antivirus-scan.com/setup.exe  adserver.com/banner/12  ads.tracker.net/click  popup-ad.com/show  doubleclick-ads.com/track  pixel-tracking.com/p.gif
win-iphone.com/survey  free-gift-cards.com/claim  survey-prize.com/winner  congratulations-winner.com/claim  miracle-cure.com/order  psychic-hotline.com/call  hack-facebook.com/password
"""
ALLOWED = """
www.cambridge.org/books/history  stanford.edu/research/groups  mit.edu/courses/algebra  uni-heidelberg.de/studium  sorbonne.fr/recherche  unam.mx/biblioteca  ox.ac.uk/admissions
nature.com/articles/cells  sciencenews.org/physics  nasa.gov/missions/voyager  noaa.gov/climate  who.int/health-topics  nih.gov/medicine/heart  europa.eu/policies/transport
bbc.co.uk/news/world  nytimes.com/2019/04/opinion  theguardian.com/environment  lemonde.fr/culture  spiegel.de/politik  elpais.com/deportes  reuters.com/markets  zeit.de/wissen
en.wikipedia.org/wiki/Rome  de.wiktionary.org/wiki/Haus  britannica.com/topic/opera  gutenberg.org/ebooks/1342  archive.org/details/maps  wikisource.org/poems
docs.python.org/3/library  developer.mozilla.org/en/docs  kernel.org/releases  gnu.org/software/bash  debian.org/doc  postgresql.org/about  stackoverflow.com/questions/11227809
github.com/torvalds/linux  blog.rust-lang.org/2021  apache.org/foundation  www.w3.org/standards  ietf.org/rfc/2616  learn.microsoft.com/dotnet  openstreetmap.org/node/5
allrecipes.com/recipe/bread  bonappetit.com/pasta  marmiton.org/recettes  chefkoch.de/rezepte/kuchen  recetas.es/paella  kitchen-stories.com/soup  www.tea-and-cakes.co.uk/menu
gardening.com/roses  bird-watching.org/owls  mountain-hikes.com/alps  cycling-routes.eu/danube  sailing-today.com/harbour  chess.com/openings  knitting-patterns.com/hats
city-museum.org/exhibitions  national-gallery.org.uk/paintings  opera-house.com/season  local-library.org/opening-hours  townhall.gov/minutes  school-district.org/calendar
travel-italy.com/florence  lonelyplanet.com/japan  weather.com/today/forecast  timetables.org/trains  hotels-by-the-sea.com/rooms  ferry-lines.com/tickets  campsites.eu/norway
familydoctor.org/sleep  hospital.org/departments  parenting.com/toddlers  vet-clinic.com/cats  pharmacology-journal.org/issue/4  dental-care.org/children  yoga-studio.com/classes
bank.com/branches  insurance.org/home  tax.gov/forms  jobs.com/engineer  lawyers.org/family  accounting-basics.com/ledger  economics.org/essays  real-estate.com/houses
m.sports.com/tennis/results  football-club.com/players  olympics.com/athletes  marathon.org/training  blog.fishing.com/rivers  www.horse-riding.com/lessons  rugby.com/fixtures
music-school.com/violin  jazz.org/concerts  film-festival.com/programme  theatre.org/plays/hamlet  poetry.org/sonnets  bookshop.com/novels  photo-club.org/landscapes
furniture.com/tables  toys.com/puzzles  shoes.com/winter  tools.com/hammers  bicycles.com/parts  garden-centre.com/seeds  blog.sewing.com/patterns/12.html  lighting.com/lamps
forum.astronomy.org/topic/12?page=2  maths-help.org/fractions  geology.org/rocks  old-maps.com/england  grammar.org/verbs  languages.com/en/lesson/7  m.trains.com/fr/12  example.org/index.html
freedom-of-press.org/reports  winter-sports.com/ski  windows-help.com/printer  betty-smith.com/essays  essex.gov.uk/parks  middlesex.edu/staff  adulteducation.org/courses  passport.gov/apply
"""


def _rows() -> list[tuple[str, int]]:
    return [(u, y) for text, y in ((BLOCKED, 1), (ALLOWED, 0)) for u in text.split()]


#: (url without its scheme, 1 for block).
LABELLED = [*_rows(), ("", 0)]


def _after_scheme(url: Column) -> Column:
    """What follows the first ``://``; empty if there is none."""
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")


def host(url: Column) -> Column:
    """After the first ``://`` up to ``/ ? #`` or the end, A-Z lower-cased; empty if there is none."""
    return F.translate(F.regexp_extract(_after_scheme(url), r"^[^/?#]*", 0), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path(url: Column) -> Column:
    """From the host's end up to ``?``, ``#`` or the end."""
    return F.regexp_extract(_after_scheme(url), r"^[^/?#]*+(/[^?#]*)", 1)


def ruled(df: DataFrame, rules: tuple[tuple[str, str], ...] = RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits ``host`` and ``path``; null where none does."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for says, where in sorted(rules, key=lambda r: len(r[1])):
        name, _, rest = where.partition("/")
        fits = ((F.col("host") == name) | F.col("host").endswith(f".{name}")) & F.col("path").startswith(f"/{rest}")
        rule, verdict = F.when(fits, F.lit(where)).otherwise(rule), F.when(fits, F.lit(says)).otherwise(verdict)
    return rule, verdict


def features(where: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(url's number, slot) of the distinct slots of each url's n-grams; the host is marked off by ``^`` and ``$``."""
    marked = [f"^{name}${cut}{rest}" for name, cut, rest in (w.partition("/") for w in where)]
    codes = np.frombuffer("".join(marked).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    owner = np.repeat(np.arange(len(where)), [len(m) for m in marked])
    found = []
    for n in SIZES:
        if len(codes) < n:
            continue
        h = np.full(len(codes) - n + 1, n, np.uint64)
        for k in range(n):
            h = hashing.mix(h + codes[k : len(codes) - n + 1 + k])
        inside = owner[: len(h)] == owner[n - 1 :]
        found.append(owner[: len(h)][inside] << BITS | (h[inside] & np.uint64((1 << BITS) - 1)).astype(np.int64))
    keys = np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)
    return keys >> BITS, keys & ((1 << BITS) - 1)


@lru_cache(maxsize=1)
def weights(steps: int = 1500, rate: float = 8.0, ridge: float = 1e-4) -> tuple[np.ndarray, float]:
    """(weights, intercept), fitted on ``LABELLED``."""
    row, slot = features([u for u, _ in LABELLED])
    x = np.zeros((len(LABELLED), 1 << BITS))
    x[row, slot] = 1
    x /= np.sqrt(np.maximum(1, x.sum(axis=1, keepdims=True)))
    y = np.array([label for _, label in LABELLED], float)
    w, b = np.zeros(1 << BITS), 0.0
    for _ in range(steps):
        gap = 1 / (1 + np.exp(-(x @ w + b))) - y
        w -= rate * (x.T @ gap / len(y) + ridge * w)
        b -= rate * gap.mean()
    return w, b


def probabilities(where: list[str]) -> np.ndarray:
    """Of block, for urls without their schemes."""
    w, b = weights()
    row, slot = features(where)
    sums, n = np.bincount(row, w[slot], len(where)), np.bincount(row, minlength=len(where))
    return 1 / (1 + np.exp(-(sums / np.sqrt(np.maximum(1, n)) + b)))


def blocked(where: Column) -> Column:
    """The model's probability of block; null, and without cost, for null."""

    @F.pandas_udf("double")
    def judge(urls: pd.Series) -> pd.Series:
        out = pd.Series(np.full(len(urls), np.nan)).astype(object).where(lambda x: x.notna(), None)
        some = urls.notna().to_numpy()
        texts = urls[some].tolist()
        # long urls go in smaller groups
        at, found = 0, []
        while at < len(texts):
            end, size = at, 0
            while end < len(texts) and (end == at or size + len(texts[end]) <= CHUNK):
                size += len(texts[end])
                end += 1
            found.append(probabilities(texts[at:end]))
            at = end
        if found:
            out[some] = np.concatenate(found)
        return out

    return judge(where)


def judged(pages: DataFrame, threshold: float = 0.5, keep: tuple[str, ...] = ("page_id",)) -> DataFrame:
    """host, path, rule, verdict and p_block (null where a rule has decided) of every url."""
    c = F.col
    rows = pages.select(*keep, host(c("url")).alias("host"), path(c("url")).alias("path"))
    rule, says = ruled(rows)
    rows = rows.withColumns({"rule": rule, "_says": says})
    rows = rows.withColumn("p_block", blocked(F.when(c("_says").isNull(), F.concat("host", "path"))))
    verdict = F.coalesce("_says", F.when(c("p_block") >= threshold, "block").otherwise("allow"))
    return rows.select(*keep, "host", "path", "rule", verdict.alias("verdict"), "p_block")


def op7(pages: DataFrame) -> DataFrame:
    """The contract's columns."""
    return judged(pages.select("page_id", "url")).drop("p_block")
