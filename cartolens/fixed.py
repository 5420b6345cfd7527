"""Values that the results depend on, as plain text. An organisation's own hosts come from its configuration: in the patterns
below {domain} stands for its domain (as a regular expression in embeds) and {portal} for its ArcGIS portal's host."""

# Network hosts (pattern, vendor, type, confidence), first match wins.
HOSTS = """
maps.googleapis.com google interactive_webmap high
maps.gstatic.com google interactive_webmap high
api.mapbox.com mapbox interactive_webmap high
events.mapbox.com mapbox interactive_webmap high
js.arcgis.com esri interactive_webmap high
{portal} esri gis_application high
services.arcgis.com esri interactive_webmap high
tiles.arcgis.com esri interactive_webmap high
gis.{domain} esri-enterprise gis_application high
maps.{domain} esri-enterprise gis_application high
*.geocortex.com esri-enterprise gis_application high
*.vertigisstudio.com esri-enterprise gis_application high
*.vertigis.com esri-enterprise gis_application medium
*.arcgis.com esri gis_application medium
*.arcgisonline.com esri interactive_webmap high
tile.openstreetmap.org osm interactive_webmap high
*.tile.openstreetmap.org osm interactive_webmap high
dev.virtualearth.net bing interactive_webmap high
*.virtualearth.net bing interactive_webmap medium
*.hereapi.com here interactive_webmap high
api.tomtom.com tomtom interactive_webmap high
*.cartocdn.com carto interactive_webmap high
api.maptiler.com maptiler interactive_webmap high
tiles.stadiamaps.com stadia interactive_webmap high
*.thunderforest.com thunderforest interactive_webmap high
unpkg.com/leaflet* leaflet interactive_webmap high
cdn.jsdelivr.net/npm/leaflet* leaflet interactive_webmap high
cdnjs.cloudflare.com/ajax/libs/leaflet/* leaflet interactive_webmap high
unpkg.com/maplibre-gl* maplibre interactive_webmap high
cdn.jsdelivr.net/npm/ol* openlayers interactive_webmap medium
atlas.microsoft.com azure interactive_webmap high
*.cesium.com cesium interactive_webmap high
*.datawrapper.de datawrapper thematic_chart_map low
*.dwcdn.net datawrapper thematic_chart_map low
code.highcharts.com/maps/* highcharts thematic_chart_map high
code.highcharts.com/mapdata/* highcharts thematic_chart_map high
public.tableau.com tableau embedded_third_party low
app.powerbi.com powerbi embedded_third_party low
storymaps.arcgis.com esri story_map high
"""

# Request paths (regex, vendor, type, confidence), first match wins.
PATHS = r"""
[?&]request=GetMap\b ogc interactive_webmap high
[?&]request=GetCapabilities\b ogc interactive_webmap medium
[?&]request=GetFeature\b ogc interactive_webmap medium
/geoserver/ geoserver interactive_webmap high
/mapserver/ mapserver interactive_webmap high
/arcgis/rest/services/ esri-enterprise interactive_webmap high
/wms(\?|/|$) ogc interactive_webmap medium
/wmts(\?|/|$) ogc interactive_webmap medium
/wfs(\?|/|$) ogc interactive_webmap medium
/VectorTileServer/ esri interactive_webmap high
"""

# Static map services (regex, vendor, type, confidence), first match wins.
STATIC_MAPS = r"""
maps\.googleapis\.com/maps/api/staticmap google static_map_image high
api\.mapbox\.com/styles/v1/[^/]+/[^/]+/static/ mapbox static_map_image high
dev\.virtualearth\.net/REST/v1/Imagery/Map bing static_map_image high
api\.maptiler\.com/maps/[^/]+/static/ maptiler static_map_image high
"""

# Fixed value: tiles of any server, after all other request rules.
TILE = r"/\d{1,2}/\d+/\d+\.(png|jpg|jpeg|webp|pbf|mvt)(\?|$) unknown-tiles interactive_webmap medium"

# Embeds and links (regex, vendor, type, confidence, label, fixed identity or nothing), first match wins.
EMBEDS = r"""
arcgis\.com/apps/webappviewer | esri | gis_application | high | ArcGIS Web AppBuilder
arcgis\.com/apps/experience/ | esri | gis_application | high | ArcGIS Experience Builder
arcgis\.com/apps/dashboards/ | esri | gis_application | high | ArcGIS Dashboards
arcgis\.com/apps/opsdashboard/ | esri | gis_application | high | ArcGIS Operations Dashboard
arcgis\.com/apps/instant/ | esri | gis_application | high | ArcGIS Instant App
arcgis\.com/apps/mapviewer/ | esri | interactive_webmap | high | ArcGIS Map Viewer
arcgis\.com/apps/View/ | esri | gis_application | high | ArcGIS Configurable App
arcgis\.com/apps/Embed/ | esri | interactive_webmap | high | ArcGIS Embed
arcgis\.com/apps/[A-Za-z0-9_-]+/index\.html | esri | gis_application | medium | ArcGIS Configurable App
arcgis\.com/apps/ | esri | gis_application | medium | ArcGIS App
arcgis\.com/home/webmap/viewer | esri | interactive_webmap | high | ArcGIS Classic Map Viewer
arcgis\.com/home/item\.html | esri | gis_application | medium | ArcGIS Item
storymaps\.arcgis\.com/ | esri | story_map | high | ArcGIS StoryMaps
arcgis\.com/apps/(MapJournal|MapSeries|Cascade|MapTour|Shortlist|StoryMap) | esri | story_map | high | ArcGIS Classic Story Map
arcg\.is/ | esri | gis_application | medium | ArcGIS short link
google\.com/maps/embed | google | interactive_webmap | high | Google Maps Embed
google\.com/maps/d/ | google | interactive_webmap | high | Google My Maps
google\.com/maps/(dir|place|search)/|google\.com/maps\?q=|maps\.google\.com/maps\?q= | google | map_link_only | medium | Google Maps directions/place link | link:google.com/maps
google\.com/maps(/|\?|$) | google | interactive_webmap | medium | Google Maps
goo\.gl/maps/ | google | interactive_webmap | medium | Google Maps short link
maps\.app\.goo\.gl/ | google | interactive_webmap | medium | Google Maps short link
maps\.google\.com/ | google | interactive_webmap | medium | Google Maps
openstreetmap\.org/export/embed | osm | interactive_webmap | high | OSM Embed
openstreetmap\.org/ | osm | interactive_webmap | medium | OpenStreetMap
/Html5Viewer/ | esri-enterprise | gis_application | high | Geocortex Html5Viewer (ArcGIS Enterprise)
/Geocortex/ | esri-enterprise | gis_application | high | Geocortex (ArcGIS Enterprise)
public\.tableau\.com/ | tableau | embedded_third_party | medium | Tableau Public
app\.powerbi\.com/ | powerbi | embedded_third_party | medium | Power BI
datawrapper\.dwcdn\.net/ | datawrapper | thematic_chart_map | low | Datawrapper
public\.flourish\.studio/ | flourish | thematic_chart_map | low | Flourish
bing\.com/maps | bing | interactive_webmap | medium | Bing Maps
mapbox\.com/ | mapbox | interactive_webmap | low | Mapbox
services\.arcgis\.com/[^/]+/arcgis/rest/services/ | esri | interactive_webmap | high | ArcGIS Online hosted service (FeatureServer/MapServer)
tiles\.arcgis\.com/tiles/[^/]+/arcgis/rest/services/ | esri | interactive_webmap | high | ArcGIS Online hosted tile service
gis\.{domain}/ | esri-enterprise | gis_application | medium | County ArcGIS Enterprise host
maps\.{domain}/ | esri-enterprise | gis_application | medium | County map host
[a-z0-9.-]*geocortex\.com/ | esri-enterprise | gis_application | high | Geocortex cloud viewer (VertiGIS)
[a-z0-9.-]*vertigisstudio\.com/ | esri-enterprise | gis_application | high | VertiGIS Studio (cloud)
/arcgis/(apps|rest)/ | esri-enterprise | gis_application | medium | ArcGIS Enterprise
\bmaps?\.[a-z0-9-]+\.(gov|org|us)/ | unknown | interactive_webmap | low | Map subdomain
"""

# Map libraries' globals (name, vendor, type, confidence); their presence is observed by the renderer.
GLOBALS = """
L leaflet interactive_webmap high
mapboxgl mapbox interactive_webmap high
maplibregl maplibre interactive_webmap high
google.maps google interactive_webmap high
ol openlayers interactive_webmap high
Cesium cesium interactive_webmap high
H here interactive_webmap high
Microsoft.Maps bing interactive_webmap high
atlas azure interactive_webmap high
tt tomtom interactive_webmap high
esri esri interactive_webmap high
require+dojo esri interactive_webmap medium
Highcharts.maps highcharts thematic_chart_map high
d3.geo d3 thematic_chart_map low
Plotly.geo plotly thematic_chart_map low
Datawrapper datawrapper thematic_chart_map medium
"""

# Map containers (selector, vendor, type, confidence).
SELECTORS = """
.leaflet-container | leaflet | interactive_webmap | high
.mapboxgl-map | mapbox | interactive_webmap | high
.maplibregl-map | maplibre | interactive_webmap | high
.ol-viewport | openlayers | interactive_webmap | high
.esri-view | esri | interactive_webmap | high
.esri-map | esri | interactive_webmap | high
.esriMapContainer | esri | interactive_webmap | high
.gm-style | google | interactive_webmap | high
gmp-map | google | interactive_webmap | high
.cesium-viewer | cesium | interactive_webmap | high
.H_imprint, .H_ui | here | interactive_webmap | high
.atlas-map | azure | interactive_webmap | medium
.highcharts-map-series | highcharts | thematic_chart_map | high
.datawrapper-map, .dw-chart | datawrapper | thematic_chart_map | low
.js-plotly-plot .geo | plotly | thematic_chart_map | medium
[class*="map-canvas"] | unknown | interactive_webmap | low
[id*="map"][class*="container"] | unknown | interactive_webmap | low
"""

# Hints in the page source (regex, vendor, type, confidence); each that matches counts.
STATIC_HTML = r"""
\bL\.map\s*\( | leaflet | interactive_webmap | medium
new\s+google\.maps\.Map\b | google | interactive_webmap | high
new\s+mapboxgl\.Map\b | mapbox | interactive_webmap | high
new\s+maplibregl\.Map\b | maplibre | interactive_webmap | high
new\s+ol\.Map\b | openlayers | interactive_webmap | high
esri/(Map|views/MapView|WebMap)\b | esri | interactive_webmap | medium
Highcharts\.mapChart\b | highcharts | thematic_chart_map | high
d3\.geo(Path|Mercator|Albers)\b | d3 | thematic_chart_map | medium
class="[^"]*\bleaflet-container\b | leaflet | interactive_webmap | high
class="[^"]*\bmapboxgl-map\b | mapbox | interactive_webmap | high
class="[^"]*\bgm-style\b | google | interactive_webmap | high
<gmp-map\b | google | interactive_webmap | high
data-map-(id|config|lat|lng|center)\b | unknown | interactive_webmap | low
mapbox://styles/[^"'\s]+ | mapbox | interactive_webmap | high
"""

# Words of a path or title that make a page worth rendering.
MAP_ADJACENT = "map gis viewer locator explorer dashboard find where location parcel zoning district boundary".split()

# Ancestors that make a finding site chrome, in order.
CHROME = """
header
nav
footer
[role=navigation]
[role=banner]
[role=contentinfo]
[role=menubar]
.region-header
.region-navigation
.region-primary-menu
.region-secondary-menu
.region-footer
.region-footer-first, .region-footer-second, .region-footer-third, .region-footer-fourth
.region-pre-footer, .region-post-footer
.region-branding
.site-header, .site-footer, .site-nav
.mega-menu, .megamenu, .mm-menu, .main-menu, .menu--main, .menu--footer
.block-menu, .block-system-branding-block, .block-superfish, .block-we-megamenu
#header, #footer, #navigation, #main-menu, #mega-menu, #block-mainnavigation, #block-footer
.layout-container > header, .layout-container > footer
.dialog-off-canvas-main-canvas > header, .dialog-off-canvas-main-canvas > footer
.toolbar, #toolbar-administration, .skip-link
"""
# Fixed value: those entries of the list above that stay chrome inside main content.
STRONG_CHROME = r"^(header|footer|\[role=banner\]|\[role=contentinfo\]|\.region-|\.site-|\.mega|\.megamenu|#header|#footer|#mega|\.block-|\.layout-container|\.dialog-off-canvas)"
# Ancestors that make a finding main content.
MAIN = """
main
[role=main]
#main-content, #main, #content, .main-content, .region-content, .node__content, .field--name-body, .layout-content, article
"""
# Links of libraries to themselves, which are no applications.
IGNORED_LINKS = """
.leaflet-control-attribution
.mapboxgl-ctrl-attrib, .maplibregl-ctrl-attrib
.ol-attribution
.esri-attribution, .esriAttribution
.gm-style-cc
[class*=attribution]
"""
IGNORED_LINK_TEXT = r"^\s*(©|\(c\)|powered by|improve this map|terms)"

# Fixed value: nearby text of drawings that are no maps.
NON_GEOGRAPHIC = r"\b(floor ?plan|seating|seat map|seat chart|site plan|campus map|org chart|building map)\b"

# Query parameters that name an application, and those that carry a credential, in order.
IDENTIFYING = "id appid webmap mid app config layout storymap dashboard pb q center markers path style".split()
CREDENTIALS = "key access_token apikey api_key token".split()

# Consent management signals.
CMP_GLOBALS = "__tcfapi __gpp __uspapi OneTrust Cookiebot truste UC_UI Osano Termly _iub".split()
CMP_ASSETS = "cookielaw.org otSDKStub.js cookiebot.com trustarc.com usercentrics.eu privacy-center.io privacy-mgmt.com osano.com termly.io cookieyes.com iubenda.com cookie-script.com cookieconsent".split()

CMP_GTAG = r"gtag\s*\(\s*['\"]consent['\"]\s*,\s*['\"]default['\"]"
CMP_ACCEPT = r"^(accept( all)?( cookies)?|i accept|agree|i agree|allow( all)?( cookies)?|got it|ok(ay)?|yes|continue)$"
CMP_COOKIES = """
OptanonAlertBoxClosed 2024-01-01T00:00:00.000Z
OptanonConsent isGpcEnabled=0&groups=C0001:1,C0002:1,C0003:1,C0004:1
CookieConsent {stamp:'x',necessary:true,preferences:true,statistics:true,marketing:true,method:'explicit',ver:1}
cookieconsent_status allow
cookie_consent true
cookies_accepted true
euconsent-v2 CPxxxxx
cmplz_consent_status allow
cmplz_marketing allow
"""

# Attributes that hold a URL, in the order they are tried.
URL_ATTRIBUTES = "src href data-src data-lazy-src data-url data-href data-iframe-src data-embed data srcdoc".split()

# Application types by rank, HTTP statuses that mean the crawler is being refused.
TYPE_RANK = {"gis_application": 7, "story_map": 6, "interactive_webmap": 5, "embedded_third_party": 4, "thematic_chart_map": 4, "static_map_image": 3,
    "non_geographic": 2, "map_link_only": 1}
FLAGGED_TYPES = ("map_link_only", "non_geographic")
CONFIDENCE = {"high": 3, "medium": 2, "low": 1}
BLOCK_STATUSES = (401, 403, 429, 502, 503, 504)

# Extensions of files that are no pages, and tracking parameters (globs).
ASSET_EXTENSIONS = "pdf jpg jpeg png gif svg webp zip doc docx xls xlsx ppt pptx csv mp4 mp3 ics xml rss json txt".split()
TRACKING = "utm_* fbclid gclid mc_cid mc_eid dclid msclkid".split()

# Attributes that hold the URL of an embed that scripts load later, and elements that other passes look at.
LAZY_ATTRIBUTES = "data-src data-url data-href data-iframe-src data-embed".split()
NOT_LAZY = "iframe img a object embed source".split()

# Links that lead to no page, by scheme; those that lead to no page to crawl; URLs anywhere in a page's source.
NO_PAGE = r"(?:mailto|tel|javascript):"
NO_CRAWL = r"(?:mailto|tel|javascript|data):"
SOURCE_URL = r"https?://[^\s\"'<>()\\]+"
STYLE_IN_SOURCE = r"mapbox://styles/[^\"'\s]+"
HEADINGS = "h1 h2 h3 figcaption".split()

# Where identities stand in URLs.
STYLE_URI = r"mapbox://styles/([^/?#\s\"']+)/([^/?#\s\"']+)"
STYLE_API = r"/styles/v1/([^/]+)/([^/]+)"
ITEM_ID = r"\b[0-9a-f]{32}\b"
ITEM_PATH = r"/(?:experience|dashboards|opsdashboard|stories|collections|instant/[a-z0-9_-]+|apps/[A-Za-z]+)/([0-9a-f]{32})\b"
ITEM_PARAMS = "id appid webmap".split()
SERVICE_HOST = r"(services|tiles)\d*\.arcgis\.com"
SERVICE_PATH = r"/(?:tiles/)?([A-Za-z0-9]{8,32})/arcgis/rest/services/(.+?)/(?:FeatureServer|MapServer|ImageServer|VectorTileServer|SceneServer)\b"
ORG_HOST = r"([a-z0-9-]+)\.maps\.arcgis\.com"
KEPT_PARAMS = "appid webmap id viewer mid".split()
#: Longest value of an identifying parameter that a key spells out.
LONGEST_VALUE = 64
# Fixed value: beginnings of keys that name one application wherever it is embedded.
STRONG_KEYS = "arcgis:item: mapbox:style: gmymaps:".split()

# Labels of reports.
HOW = {"link": "link", "embed": "iframe_embed", "image": "static_image", "page": "in_page"}
KIND_SCRIPT, KIND_IMAGE, KIND_PAGE = "ArcGIS JS API map (in page)", "Static map image", "In-page map ({vendor})"
HOSTING = {"item": "ArcGIS Online", "service": "ArcGIS Online hosted service", "esri-enterprise": "ArcGIS Enterprise (county)", "esri": "Esri (no item id)"}
SUMMARY = {"chrome": "site-wide navigation", "both": "content + navigation", "content": "content"}
KEY_LIMITS = {
    "none": "not probed", "vendor": "not probed (vendor)", "referrer": "referrer-restricted", "other": "restricted/other: ",
        "open": "UNRESTRICTED (works without a referrer)", "unknown": "unknown: ", "url": "URL-restricted",
    "token": "UNRESTRICTED (no allowed URLs)",
}
# Libraries whose global says nothing of a container.
CHART_VENDORS = ("d3", "plotly")
