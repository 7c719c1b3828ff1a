"""Structured data from rows: JSON-LD of six kinds, without members that are null."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SCHEMA = "https://schema.org"
# What an order's block says where its row says nothing, and on which platforms it stands.
DELIVERY, PLATFORMS = ("OnSitePickup", "ParcelService"), ("DesktopWebPlatform", "MobileWebPlatform")
TABLE_BOOKING = "FoodEstablishmentReservation"


class _Row:
    """Columns of a table by name; those that it lacks are null."""

    def __init__(self, df: DataFrame) -> None:
        self.names = set(df.columns)

    def __call__(self, name: str, kind: str | None = None) -> Column:
        c = F.col(name) if name in self.names else F.lit(None)
        return c.cast(kind) if kind else c.cast("string") if name not in self.names else c

    def list(self, name: str) -> Column:
        """An array of texts; null if it is empty."""
        c = self(name, "array<string>")
        return F.when(F.size(c) > 0, c)


def _object(type_: Column | str, **members: Column) -> Column:
    kind = F.lit(type_) if isinstance(type_, str) else type_
    return F.struct(kind.alias("@type"), *[c.alias(n.replace("_id", "@id")) for n, c in members.items()])


def _urls(names: tuple[str, ...]) -> Column:
    return F.array(*[F.lit(f"{SCHEMA}/{n}") for n in names])


def _reservation(r: _Row) -> tuple:
    kind, provider = r("reservation_kind"), r("provider")
    under = F.when(r("customer_name").isNotNull() | r("customer_email").isNotNull(), _object("Person", name=r("customer_name"), email=r("customer_email")))
    place = _object(F.when(kind == TABLE_BOOKING, "FoodEstablishment").otherwise("Place"), name=F.coalesce(r("reservation_for_name"), provider))
    return kind, {"reservationStatus": F.lit(f"{SCHEMA}/ReservationConfirmed"), "provider": _object("Organization", name=provider), "reservationFor": place, "startTime": r("start"), "endTime": r("end"), "partySize": r("party_size", "long"), "reservationId": r("reservation_id"), "underName": under}


def _order(r: _Row) -> tuple:
    target = _object("EntryPoint", urlTemplate=r("order_url"), inLanguage=F.lit("en-US"), actionPlatform=_urls(PLATFORMS))
    price = _object("PriceSpecification", eligibleTransactionVolume=_object("PriceSpecification", minPrice=F.lit(0), priceCurrency=F.lit("USD")))
    methods = F.transform(r.list("accepted_payment_method"), lambda m: F.struct(F.lit("PaymentMethod").alias("@type"), m.alias("name")))
    return F.lit("OrderAction"), {"name": r("name"), "target": target, "deliveryMethod": F.coalesce(r.list("delivery_method"), _urls(DELIVERY)), "priceSpecification": price, "merchant": _object("Organization", name=r("merchant")), "acceptedPaymentMethod": methods}


def _discussion(r: _Row) -> tuple:
    likes = r("likes", "long")
    counter = F.when(likes.isNotNull(), F.array(_object("InteractionCounter", interactionType=F.lit(f"{SCHEMA}/LikeAction"), userInteractionCount=likes)))
    return F.lit("DiscussionForumPosting"), {"headline": r("headline"), "author": _object("Person", name=r("author")), "datePublished": r("date"), "url": r("url"), "mainEntityOfPage": _object("WebPage", _id=r("url")), "text": r("text"), "dateModified": r("date_modified"), "commentCount": r("comment_count", "long"), "interactionStatistic": counter}


def _profile(r: _Row) -> tuple:
    works = F.when(r("works_for").isNotNull(), _object("Organization", name=r("works_for")))
    person = _object("Person", name=r("name"), url=r("url"), description=r("description"), worksFor=works, image=r("image"), jobTitle=r("job_title"), sameAs=r.list("same_as"), knowsAbout=r.list("knows_about"))
    return F.lit("ProfilePage"), {"mainEntity": person, "url": r("url")}


def _organization(r: _Row) -> tuple:
    contact = F.when(r("telephone").isNotNull() | r("email").isNotNull(), _object("ContactPoint", contactType=F.lit("customer support"), telephone=r("telephone"), email=r("email")))
    return F.lit("Organization"), {"name": r("name"), "url": r("url"), "logo": r("logo"), "description": r("description"), "sameAs": r.list("same_as"), "contactPoint": contact}


def _local_business(r: _Row) -> tuple:
    some = r("street").isNotNull() | r("city").isNotNull() | r("postal_code").isNotNull()
    address = F.when(some, _object("PostalAddress", streetAddress=r("street"), addressLocality=r("city"), addressRegion=r("region"), postalCode=r("postal_code"), addressCountry=r("country")))
    lat, lon = r("latitude", "double"), r("longitude", "double")
    geo = F.when(lat.isNotNull() & lon.isNotNull(), _object("GeoCoordinates", latitude=lat, longitude=lon))
    return r("business_type"), {"name": r("name"), "url": r("url"), "telephone": r("telephone"), "address": address, "geo": geo, "openingHours": r.list("hours"), "sameAs": r.list("same_as")}


KINDS = {"reservation": _reservation, "order": _order, "discussion": _discussion, "profile": _profile, "organization": _organization, "local_business": _local_business}


def generated(rows: DataFrame, kind: str, script_tag: bool = False) -> DataFrame:
    """rows with json: the block of a kind (KINDS), from the columns that its function names; others are left alone.

    Columns that rows lacks and nulls give no member, at any depth; lists that are empty neither. Members stand in the
    order of the kind. With script_tag the block stands in the element that a page holds it in.
    """
    type_, members = KINDS[kind](_Row(rows))
    block = F.struct(F.lit(SCHEMA).alias("@context"), type_.alias("@type"), *[c.alias(n) for n, c in members.items()])
    json = F.to_json(block)
    return rows.withColumn("json", F.concat(F.lit('<script type="application/ld+json">\n'), json, F.lit("\n</script>")) if script_tag else json)
