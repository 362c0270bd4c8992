from terrarank.operators import places


def test_boroughs_and_full_state_names(spark):
    counties = spark.createDataFrame([("36047", "Kings County", "NY", 2_600_000), ("48453", "Travis County", "TX", 1_300_000), ("17167", "Sangamon County", "IL", 190_000)],
                                     "county string, county_name string, state string, population long")
    areas = spark.createDataFrame([(1, "17167", "Springfield", 4000, 39.8, -89.6), (2, "48453", "Zilker, Austin · 78704", 5000, 30.2, -97.7)],
                                  "area long, county string, label string, population long, lat double, lon double")
    index = places.place_index(areas, counties)
    assert index.filter("kind = 'county'").count() == 4   # Kings County is also Brooklyn
    typed = ["brooklyn", "Springfield, Illinois", "springfield tx", "zilker texas", "brooklyn new york", "78704 texas", "kings"]
    hits = places.search_places(index, spark.createDataFrame(list(enumerate(typed)), "query_id long, text string")).collect()
    found = {typed[h.query_id]: (h.kind, h.name, h.county, h.where) for h in hits if h.position == 1}
    kings = ("county", "Brooklyn", "36047", "Kings County, NY")
    assert found.pop("kings")[1] == "Kings County"
    assert found == {"brooklyn": kings, "brooklyn new york": kings, "Springfield, Illinois": ("city", "Springfield", "17167", "Sangamon County, IL"),
                     "zilker texas": ("neighborhood", "Zilker", "48453", "Austin, TX"), "78704 texas": ("zip", "78704", "48453", "Austin, TX")}
