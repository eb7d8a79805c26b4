"""Schemas of landed tables and provider payloads."""

from __future__ import annotations

from pyspark.sql.types import StructType


def table(columns: str) -> StructType:
    """Schema of ``name type`` pairs; needs no running session."""
    out = StructType()
    for column in columns.split(","):
        name, kind = column.split()
        out = out.add(name, kind)
    return out


# Column names and types of the row store.
HOTEL = table("""
    id long, hotel_id string, source string, source_hotel_id string, name string,
    city string, country string, latitude double, longitude double, street_address string,
    postal_code string, phone string, website string, email string, amadeus_rating double,
    google_rating double, tripadvisor_rating double, booking_rating double,
    recommended boolean, admin_flag boolean, quality boolean, quiet boolean,
    important_note string, type string, dupe_id long, iata_code string,
    address_json string, geo_code_json string, distance_json string, last_update string,
    created_at timestamp, updated_at timestamp, state_code string, number_of_reviews integer,
    number_of_ratings integer, overall_rating double, sentiments string
""")

REVIEW = table("""
    id integer, hotel_id string, source string, source_review_id string, reviewer_name string,
    reviewer_location string, rating double, review_text string, review_date timestamp,
    verified boolean, helpful_count integer, room_type string, travel_type string,
    stay_date timestamp, created_at timestamp, updated_at timestamp,
    google_maps_uri string, photo_name string, insert_id string
""")

AIRPORT_CITY = table(
    "iata_code string, name string, country string, airport_count integer, country_codes string"
)
CITY = table("name string, country string, continent string")
AIRPORT = table("""
    id string, name string, city string, country string, iata string, icao string, lat string,
    lon string, altitude string, timezone string, dst string, tz_db string, type string,
    source string
""")
UNAVAILABLE_HOTEL = table("id long, hotel_id string, created_at timestamp")

# Payload shapes of the providers.
HOTEL_LIST_PAYLOAD = """struct<data: array<struct<
    type: string, hotelId: string, chainCode: string, dupeId: bigint, name: string,
    iataCode: string, address: string, geoCode: string, distance: string, lastUpdate: string>>,
    meta: struct<count: int, links: struct<next: string>>>"""
HOTEL_ADDRESS = """struct<cityName: string, countryCode: string, lines: array<string>,
    postalCode: string, stateCode: string>"""
HOTEL_SEARCH_PAYLOAD = """struct<data: array<struct<
    type: string, hotelId: string, name: string, rating: int, officialRating: int,
    available: boolean, lastUpdate: string>>>"""
HOTEL_RATINGS_PAYLOAD = """struct<data: array<struct<
    type: string, hotelId: string, numberOfReviews: int, numberOfRatings: int,
    overallRating: int, sentiments: struct<sleepQuality: int, service: int, facilities: int,
    roomComforts: int, valueForMoney: int, catering: int, location: int, internet: int,
    pointsOfInterest: int, staff: int>, lastUpdate: string>>>"""
PLACES_PAYLOAD = """struct<places: array<struct<
    id: string, displayName: struct<text: string>, formattedAddress: string,
    location: struct<latLng: struct<latitude: double, longitude: double>>,
    rating: double, userRatingCount: int>>, nextPageToken: string>"""
LOCATION_SEARCH_PAYLOAD = """struct<data: array<struct<
    location_id: string, name: string,
    address_obj: struct<street1: string, city: string, country: string, postalcode: string>,
    latitude: string, longitude: string, rating: double, num_reviews: int, phone: string,
    website: string, email: string>>>"""
BUSINESS_SEARCH_PAYLOAD = """struct<businesses: array<struct<
    id: string, name: string, rating: double,
    location: struct<address1: string, city: string, state: string, zip_code: string,
        country: string>,
    coordinates: struct<latitude: double, longitude: double>, phone: string>>>"""
LOCATION_REVIEWS_PAYLOAD = """struct<data: array<struct<
    id: int, rating: double, helpful_votes: int, text: string, title: string,
    published_date: string,
    user: struct<username: string, review_count: int,
        user_location: struct<name: string, id: string>>>>>"""
PLACE_DETAILS_PAYLOAD = """struct<photos: array<struct<name: string>>,
    reviews: array<struct<
        authorAttribution: struct<displayName: string, uri: string>, rating: double,
        text: struct<text: string>, publishTime: string, googleMapsUri: string>>>"""
PHOTO_PAYLOAD = "struct<id: string, photos: array<struct<name: string>>>"
COMPLETION_ITEMS = """array<struct<
    Hotel: string, City: string, Review: string, Rating: double, Distance: double,
    Address: string, google_maps_uri: string, photo_name: string>>"""
