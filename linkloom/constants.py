"""Fixed values of the link model."""

from __future__ import annotations

from dataclasses import dataclass

# Base weight of a shared selector, by kind.
SELECTOR_WEIGHTS = {
    "tls_cert_sha256": 200.0, "crypto_wallet": 185.0, "legal_registration": 165.0, "ssh_fp": 95.0, "site_verification": 92.0, "contact_email": 88.0, "shared_ip": 85.0,
    "tls_spki": 80.0, "tracking_id": 70.0, "legal_entity": 68.0, "contact_phone": 60.0, "social_handle": 55.0, "legal_address": 46.0, "html_hash": 45.0,
    "favicon_mmh3": 45.0, "legal_text_hash": 45.0, "favicon_md5": 40.0, "tls_san": 40.0, "network_cidr": 30.0, "spf_origin": 30.0, "nameserver": 25.0, "asn": 15.0,
}
DEFAULT_WEIGHT = 40.0
# Weight of a tracking id, by the provider before its bar.
TRACKING_WEIGHTS = {"adsense_publisher": 190.0, "ga_property": 170.0, "fb_app_id": 75.0, "yandex_metrika": 74.0, "fb_pixel": 65.0, "tiktok_pixel": 55.0, "gtm_container": 45.0}
# Kinds that make a link strong by themselves.
DECISIVE_KINDS = ("tls_cert_sha256", "ssh_fp", "shared_ip", "tracking_id")
ACCOUNT_TRACKING = ("adsense_publisher", "ga_property")


@dataclass(frozen=True)
class Config:
    """The knobs, at their defaults."""

    degree_ceiling: int = 50
    account_degree_ceiling: int = 500
    cluster_fanout: int = 25
    san_owner_ceiling: int = 15
    path_hops: int = 3
    path_nodes: int = 200
    path_frontier: int = 50
    ip_noise_degree: int = 50
    batch: int = 500
    queue: int = 5000
    cluster_interval_s: int = 900
    reconcile_interval_s: int = 86400
    rarity_floor: float = 0.04
    overlap_floor: float = 0.25
    recency_floor: float = 0.3
    full_credit_days: int = 180
    decay_days: float = 730.0
    gap_days: float = 365.0


# Networks by what they carry.
CDN_ASNS = ("13335", "16625", "19551", "20940", "22822", "23059", "3223", "30644", "394536", "396998", "39967", "41179", "54113", "57724", "199524", "200325")
HOSTING_ASNS = ("2635", "27647", "32345", "33612")
MAIL_ASNS = ("15169", "16276", "3215", "8075")
MAIL_PTRS = ("1e100.net", "google.com", "mail.ovh.", "smtp.", "mx.", "-mx-", "mail-", "mailout", "mxbiz")
CDN_PTRS = (
    "incapsula.com", "cloudflare.com", "cloudflare.net", "fastly.net", "akamai.net", "akamaiedge.net", "akamaized.net", "edgecast.net", "sucuri.net", "imperva.com", "cdn.", "cloudfront.net",
    "azurefd.net", "googleusercontent.com", "googlehosted.com", "b-cdn.net", "edgekey.net", "edgesuite.net", "trafficmanager.net", "myshopify.com", "pantheonsite.io", "webflow.io", "wixsite.com",
    "wpenginepowered.com", "gcore.com", "gcorelabs.com", "ddos-guard.net", "llnw.net", "stackpathdns.com", "stackpathcdn.com", "keycdn.com", "cdn77.org", "myracloud.com", "pathnetwork.net",
)
HOSTING_PTRS = ("wildcard.", "weebly.com", "wordpress.com", "wix.com", "squarespace.com", "cluster", "shared-", "hosting.", "hostinger", "bluehost", "siteground", "dreamhost", "namecheap", "godaddy", "ovh.net", "o2switch.net")
MAIL_SOURCES = ("mx_record", "spf")
CDN_NAMES = (
    "cdn", "content delivery", "edge network", "edge cache", "akamai", "fastly", "cloudfront", "stackpath", "highwinds", "limelight", "lumen cdn", "cachefly", "keycdn", "bunny", "cdn77", "ngenix",
    "qrator", "gcore", "g-core", "medianova", "sucuri", "incapsula", "imperva", "edgecast", "chinacache", "wangsu", "azion", "quantil", "cloudflare", "ddos-guard", "ddosguard", "voxility",
    "myra security", "myracloud", "path network", "reblaze", "1e100.net",
)
# Labels of enrichment that mean shared infrastructure.
SHARED_LABELS = ("cdn", "hosting", "proxy", "vpn", "tor")
# Flags of enrichment that mean the same.
SHARED_FLAGS = ("hosting", "proxy", "vpn", "tor", "relay", "anonymous")
# Networks of the largest content network.
CDN_NETS = (
    "173.245.48.0/20", "103.21.244.0/22", "103.22.200.0/22", "103.31.4.0/22", "141.101.64.0/18", "108.162.192.0/18", "190.93.240.0/20", "188.114.96.0/20", "197.234.240.0/22", "198.41.128.0/17",
    "162.158.0.0/15", "104.16.0.0/13", "104.24.0.0/14", "172.64.0.0/13", "131.0.72.0/22", "2400:cb00::/32", "2606:4700::/32", "2803:f800::/32", "2405:b500::/32", "2405:8100::/32", "2a06:98c0::/29", "2c0f:f248::/32",
)
# Nameservers of large providers.
BORING_NAMESERVERS = (
    "awsdns-", "cloudflare.com", "nsone.net", "ultradns.net", "ultradns.com", "domaincontrol.com", "registrar-servers.com", "digitalocean.com", "linode.com", "azure-dns.com", "trafficmanager.net",
    "googledomains.com", "google.com", "gandi.net", "gandi.io", "ovh.net", "hetzner.com", "worldnic.com", "markmonitor.com", "dnsmadeeasy.com", "cloudns.net", "cloudns.asia", "cloudns.biz", "cloudns.cc",
    "dns-parking.com", "name-services.com", "name.com", "namecheap.com", "bluehost.com", "hostgator.com", "siteground.biz", "siteground.eu", "dreamhost.com", "wordpress.com", "wixdns.net",
    "squarespacedns.com", "webflow.io", "hover.com", "easydns.com", "pairnic.com", "transip.net", "one.com", "networksolutions.com", "inwx.eu", "metaregistrar.nl", "dnspod.net", "alidns.com", "alidns.net",
    "he.net", "afraid.org", "vercel-dns.com", "netlifydns.com", "shopify.com", "myshopify.com", "akamaiedge.net", "akam.net", "edgecastdns.net", "ns.cloudflare.com", "oraclecloud.net",
    "hostinger-dns.com", "hostinger.com", "123-reg.co.uk", "names.co.uk", "register.it", "dotroll.com", "dnsv2.com", "hichina.com", "awsdns-hostmaster.amazon.com",
)
# Names on default, placeholder and shared-platform certificates.
LOW_TLS_NAMES = ("localhost", "localhost.localdomain", "localdomain", "ip6-localhost", "ip6-loopback", "example.com", "example.org", "example.net", "example.local")
LOW_TLS_PATTERNS = ("acme staging", "default certificate", "dummy certificate", "fake certificate", "ingress controller fake certificate", "kubernetes ingress controller fake certificate", "mkcert development", "snakeoil")
LOW_HOSTING = (
    "amazonaws.com", "automattic.com", "azurefd.net", "azurewebsites.net", "bluehost.com", "cloudflare.com", "cloudflare.net", "cloudfront.net", "cloudways", "digitaloceanspaces.com", "dreamhost.com", "fastly.net",
    "firebaseapp.com", "github.com", "github.io", "githubusercontent.com", "gitlab.io", "godaddy.com", "googleapis.com", "googlehosted.com", "googleusercontent.com", "hostgator.com", "hostinger.com", "kinsta",
    "namecheap.com", "o2switch.net", "ovh.net", "pantheonsite.io", "pressable.com", "shopify.com", "siteground", "squarespace.com", "web.app", "webflow.io", "weebly.com", "wix.com", "wixsite.com", "wordpress.com",
    "wpengine.com", "wpenginepowered.com", "blogger.com", "blogspot.com", "doubleclick.net", "doubleclickusercontent.com", "ggpht.com", "google.com", "googleadservices.com", "googledrive.com",
    "googlesyndication.com", "googletagmanager.com", "googleweblight.com", "gstatic.com", "translate.goog", "usercontent.goog", "youtube.com", "ytimg.com",
)
# Registrant fields that name nobody.
REDACTED_VALUES = ("redacted", "redacted for privacy", "not disclosed", "n/a", "na", "none", "unknown", "withheld")
REDACTED_PATTERNS = (
    "redacted for privacy", "data protected", "not disclosed", "not publicly disclosed", "non-public data", "personal data", "gdpr masked", "statutory masking", "withheld for privacy", "privacy protect",
    "privacy service", "whoisguard", "whois privacy", "whois agent", "domains by proxy", "perfect privacy", "contact privacy", "identity protection", "private registration", "privacydotlink",
    "see privacyguardian", "on behalf of", "registration private",
)
# Mail domains of registrars and privacy services.
GENERIC_MAIL = (
    "godaddy.com", "secureserver.net", "namecheap.com", "namecheaphosting.com", "cloudflare.com", "domainsbyproxy.com", "whoisguard.com", "withheldforprivacy.com", "withheldforprivacy.email",
    "privacyguardian.org", "contactprivacy.com", "privacyprotect.org", "gandi.net", "ovh.net", "ionos.com", "1and1.com", "hostgator.com", "bluehost.com", "googledomains.com", "markmonitor.com",
    "cscglobal.com", "tucows.com", "enom.com", "enomdomains.com", "publicdomainregistry.com", "wildwestdomains.com", "porkbun.com", "dynadot.com", "name.com", "networksolutions.com", "register.com",
    "fastdomain.com", "key-systems.net", "1api.net", "hostinger.com", "squarespace.com", "nic.ru", "whoisproxy.ru", "reg.ru", "r01.ru", "salenames.ru", "webnames.ru", "internet.bs", "openprovider.com",
    "hosting.ua", "ukraine.com.ua",
)
PRIVACY_MAIL = r"(whois|privacy|privat|proxy|protect|redact|anonymous|withheld|hidden|contactfilter|domaindiscreet)"
# Hosts under which unrelated customers live.
NOISY_SUFFIXES = (
    "amazonaws.com", "azurewebsites.net", "bluehost.com", "cloudflare.com", "cloudflare.net", "cloudfront.net", "digitaloceanspaces.com", "fastly.net", "firebaseapp.com", "github.io", "gitlab.io", "google.com",
    "googleapis.com", "googlehosted.com", "googleusercontent.com", "mail.protection.outlook.com", "o2switch.net", "outlook.com", "ovh.net", "pantheonsite.io", "shopify.com", "squarespace.com", "web.app",
    "webflow.io", "weebly.com", "wix.com", "wixsite.com", "wordpress.com", "wpengine.com",
)
# Score of a related target by the relation that yields it.
RELATION_SCORES = {
    "dns_a": 10, "dns_aaaa": 10, "historical_dns": 8, "origin_hit": 8, "provider_hit": 8, "scan_hit": 9, "reverse_ip": 9, "zone_transfer": 9, "subdomain": 7, "subdomain_leak": 8, "mx_leak": 7,
    "wordlist_leak": 7, "cname": 6, "mx": 5, "nameserver": 3, "whois_nameserver": 3, "cross_san": 6, "ct_san": 5, "tls_cn": 8, "tls_san": 7, "ptr": 4, "spf": 4, "urlscan_url": 7,
}
# Identifier tiers, categories, and how many domains may share one.
TIER_SCORES = {"tier_1": 74, "tier_2": 46, "tier_3": 28, "tier_4": 14}
CATEGORY_SCORES = {"tls": 18, "tls_ct": 14, "ssh": 18, "identity": 14, "tracking": 12, "content": 10, "infrastructure": 8, "legal": 8, "policy": 6, "email": 5, "social": 4, "nameserver": 3, "dns": 2, "generic": 0}
FREQUENCY_RULES = {
    "tls": (10, 60), "tls_ct": (8, 40), "ssh": (4, 20), "identity": (5, 25), "tracking": (6, 30), "content": (4, 20), "infrastructure": (3, 12), "legal": (5, 25), "policy": (5, 24), "email": (5, 24), "social": (4, 18),
    "nameserver": (3, 10), "dns": (4, 16), "generic": (4, 16),
}
# Owners of a value or label beyond which it says nothing of two of them.
MOST_OWNERS = 500
# Weight of a value shared at a document path.
PATH_WEIGHTS = {
    "tls_certs.probes[*].fingerprint_sha256": 100, "ssh_host_keys.probes[*].fingerprint_sha256": 90, "tls_certs.probes[*].cn": 40, "non_cf_ips": 50, "censys.hits[*].cert_fingerprint_sha256": 55, "dns.A": 25, "dns.AAAA": 25,
    "hackertarget.hits[*].ip": 20, "urlscan.hits[*].ip": 15, "circl_pdns.records[*].rdata": 15, "crt_sh.certs[*].id": 15, "censys.hits[*].ip": 20, "shodan.hits[*].ip": 20, "netlas.hits[*].ip": 20, "dns.MX[*].exchange": 3,
    "page_metadata.google_analytics": 45, "page_metadata.gtm_ids": 40, "page_metadata.facebook_pixel": 42, "page_metadata.yandex_metrika": 42, "page_metadata.tiktok_pixel": 30, "whois.creation_date": 25, "whois.registrar": 3,
    "whois.emails": 10, "whois.country": 1, "dns.SOA.rname": 5, "dns.SOA.serial": 10, "dns.NS": 10, "crt_sh.issuers": 2, "page_metadata.adsense_publisher_ids": 48, "page_metadata.fb_app_id": 20, "page_metadata.favicon_md5": 18,
    "page_metadata.favicon_murmurhash3": 18, "page_metadata.source_map_urls": 18, "page_metadata.crypto_wallet_values": 55, "page_metadata.phone_numbers": 30, "legal_pages.phones": 34, "page_metadata.social_handle_values": 10,
    "page_metadata.authors": 8, "page_metadata.rel_me": 10, "email_security.dmarc_report_uris": 18, "email_security.spf_includes": 12, "email_security.dkim_selectors": 10, "txt_verification_tokens": 25,
    "microsoft_tenant.tenant_guid": 40, "mail_client_config.servers": 20, "mail_client_config.domains": 10, "legal_pages.entity_names": 18, "legal_pages.registration_ids": 35, "legal_pages.addresses": 14, "legal_pages.emails": 22,
    "well_known.security_contacts": 12, "well_known.assetlinks_packages": 20, "well_known.ads_txt_publishers": 18, "nameserver_analysis.vanity_apexes": 12,
}
DEFAULT_PATH_WEIGHT = 5
# Paths of addresses in a document.
IP_PATHS = ("non_cf_ips", "dns.A", "hackertarget.hits[*].ip", "urlscan.hits[*].ip", "circl_pdns.records[*].rdata")
# Paths of certificates in a document.
CERT_PATHS = ("tls_certs.probes[*].fingerprint_sha256", "tls_certs.probes[*].cn")
SSH_PATH = "ssh_host_keys.probes[*].fingerprint_sha256"
DECISIVE_PATHS = ("microsoft_tenant.tenant_guid", "legal_pages.registration_ids", "page_metadata.crypto_wallet_values")
LABEL_WEIGHT, LABEL_CAP = 8, 40
# DKIM selectors that mail software sets by default.
DEFAULT_SELECTORS = (
    "default", "dkim", "mail", "email", "smtp", "mx", "k1", "k2", "k3", "s1", "s2", "s1024", "s2048", "selector", "selector1", "selector2", "google", "zoho", "mandrill", "sendgrid", "mailjet", "amazonses", "pm", "ctct1",
    "ctct2", "sig1", "everlytickey1", "everlytickey2",
)
# Numbers that templates carry, and wallets that nobody owns.
PLACEHOLDER_PHONES = ("1234567", "1234567890", "12345678901", "0123456789", "9876543210", "5551234567", "15551234567", "5550100", "15555550100", "447700900000", "447700900123")
NULL_WALLETS = ("0x0000000000000000000000000000000000000000", "0x000000000000000000000000000000000000dead", "1111111111111111111114olvt2", "1bitcoineateraddressdontsendf59kue")

# ---- identifiers in scan documents ----

_OPENID = ("issuer", "authorization_endpoint", "token_endpoint", "userinfo_endpoint", "jwks_uri", "registration_endpoint")
_TRACKERS = {
    "ga_property": ("google_analytics", "ga_ids"), "gtm_container": ("gtm_ids", "google_tag_manager"), "fb_pixel": ("facebook_pixel",), "tiktok_pixel": ("tiktok_pixel",), "yandex_metrika": ("yandex_metrika",),
    "adsense_publisher": ("adsense_publisher_ids",), "fb_app_id": ("fb_app_id", "facebook_app_id"),
}
_ONE_OR_MORE = {
    "dns/A": [("resolved_ip", "tier_2", "infrastructure")], "dns/AAAA": [("resolved_ip", "tier_2", "infrastructure")], "dns/CNAME": [("dns_alias", "tier_4", "dns")], "dns/MX": [("mx_host", "tier_4", "email")],
    "dns/NS": [("nameserver", "tier_4", "nameserver")], "subdomains": [("subdomain_name", "tier_4", "dns")], "zone_transfer": [("subdomain_name", "tier_4", "dns")],
    "whois/emails": [("registrant_email", "tier_3", "identity")], "whois/name": [("registrant_name", "tier_3", "identity")], "whois/nameservers": [("nameserver", "tier_4", "nameserver")],
    "page_metadata/rel_me": [("rel_me_url", "tier_3", "social")], "page_metadata/authors": [("author", "tier_4", "social")], "page_metadata/twitter_site": [("twitter_site", "tier_3", "social")],
    "page_metadata/twitter_creator": [("twitter_creator", "tier_3", "social")], "page_metadata/phone_numbers": [("contact_phone", "tier_3", "identity")],
    "page_metadata/script_assets": [("script_asset_url", "tier_4", "content"), ("script_asset_host", "tier_4", "content")],
    "email_security/spf_includes": [("spf_include", "tier_4", "email")], "email_security/dmarc_rua": [("dmarc_rua", "tier_3", "email")], "email_security/dmarc_ruf": [("dmarc_ruf", "tier_3", "email")],
    "email_security/tls_rpt_rua": [("tls_rpt_rua", "tier_3", "email")], "email_security/dmarc_report_uris_by_tag/rua": [("dmarc_rua", "tier_3", "email")], "email_security/dmarc_report_uris_by_tag/ruf": [("dmarc_ruf", "tier_3", "email")],
    "email_security/dmarc_report_uris/rua": [("dmarc_rua", "tier_3", "email")], "email_security/dmarc_report_uris/ruf": [("dmarc_ruf", "tier_3", "email")],
    "crt_sh/cross_domain_sans": [("cross_san_domain", "tier_3", "tls_ct")], "cert_transparency/cross_domain_sans": [("cross_san_domain", "tier_3", "tls_ct")],
    **{f"page_metadata/{k}": [(t, "tier_2", "tracking")] for t, keys in _TRACKERS.items() for k in keys},
}
#: What a leaf is by its whole path: type, tier, category. Lists may
#: be single values as well.
IDENTIFIER_PATHS = {
    **_ONE_OR_MORE, **{f"{k}/[]": v for k, v in _ONE_OR_MORE.items()},
    "dns/MX/[]/exchange": [("mx_host", "tier_4", "email")], "spf_origins/[]/ip": [("origin_ip", "tier_4", "email")], "subdomain_followups/[]/subdomain": [("subdomain_name", "tier_4", "dns")],
    "historical_dns/records/[]/rdata": [("historical_ip", "tier_4", "infrastructure")],
    "page_metadata/favicon_mmh3": [("favicon_mmh3", "tier_2", "content")], "page_metadata/favicon_md5": [("favicon_md5", "tier_3", "content")], "page_metadata/homepage_html_hash": [("homepage_html_hash", "tier_2", "content")],
    "microsoft_tenant/tenant_guid": [("microsoft_tenant_guid", "tier_1", "identity")], "microsoft_tenant/tenant_id": [("microsoft_tenant_guid", "tier_1", "identity")],
    "legal_pages/pages/[]/normalized_text_hash": [("legal_text_hash", "tier_2", "legal")], "legal_pages/[]/normalized_text_hash": [("legal_text_hash", "tier_2", "legal")],
    "ssh_host_keys/probes/[]/fingerprint_sha256": [("ssh_host_key_sha256", "tier_1", "ssh")], "ssh_host_keys/probes/[]/md5": [("ssh_host_key_md5", "tier_2", "ssh")],
    **{f"{at}/{k}": [(f"openid_{k}", "tier_2", "identity")] for at in ("microsoft_tenant", "well_known/openid_configuration") for k in _OPENID},
    **{f"origin_candidates/{k}/[]/ip": [("origin_ip", "tier_4", "infrastructure")] for k in ("subdomain_leaks", "mx_leaks", "wordlist_leaks", "hackertarget", "urlscan")},
    **{f"origin_candidates/{k}/hits/[]/ip": [("provider_ip", "tier_3", "infrastructure")] for k in ("censys", "shodan", "netlas")},
    **{f"origin_candidates/{k}/hits/[]/hostnames/[]": [("provider_hostname", "tier_4", "infrastructure")] for k in ("censys", "shodan", "netlas")},
    **{f"origin_candidates/{k}/hits/[]/ip": [("scan_ip", "tier_3", "infrastructure")] for k in ("scan", "provider_scan", "country_scan")},
}
ADDRESS_TYPES = ("resolved_ip", "historical_ip", "origin_ip", "provider_ip", "scan_ip")
#: What a leaf is by a key on its way: pattern, type, tier, category,
#: source, and whether the pattern's group goes before the value.
IDENTIFIER_PATTERNS = (
    (r"^page_metadata/social_handles/([^/]+)(?:/\[\])?$", "social_handle", "tier_3", "social", "page_metadata.social_handles", True),
    (r"^page_metadata/crypto_wallets/([^/]+)(?:/\[\])?$", "crypto_wallet", "tier_1", "identity", "page_metadata.crypto_wallets", True),
    (r"^page_metadata/social_links/([^/]+)(?:/\[\])?$", "social_url", "tier_4", "social", "page_metadata.social_links", False),
    (r"^page_metadata/source_map_leaks/\[\](?:/(?:url|asset_url|source_map_url|map_url))?$", "source_map_url", "tier_3", "content", "page_metadata.source_map_leaks", False),
    (r"^page_metadata/source_map_leaks/\[\](?:/(?:url|asset_url|source_map_url|map_url))?$", "source_map_host", "tier_4", "content", "page_metadata.source_map_leaks", False),
    (r"^nameserver_analysis/vanity_candidates(?:/|$)", "nameserver_vanity", "tier_3", "nameserver", "nameserver_analysis.vanity_candidates", False),
    (r"(?i)^well_known/apple_app_site_association/(?:.*/)?[^/]*(?:appid|app_id)", "apple_app_id", "tier_2", "identity", "well_known.apple_app_site_association", False),
    (r"(?i)^well_known/assetlinks/(?:.*/)?[^/]*package", "android_package", "tier_2", "identity", "well_known.assetlinks", False),
    (r"(?i)^well_known/assetlinks/(?:.*/)?[^/]*(?:sha256|fingerprint)", "android_cert_sha256", "tier_1", "identity", "well_known.assetlinks", False),
    (r"(?i)^well_known/security_txt/(?:.*/)?[^/]*(?:contact|mail|email)", "contact_email", "tier_3", "policy", "well_known.security_txt", False),
    (r"(?i)^(?:mail_client_config|mail_config)/[^/]+/(?:\[\]/)?(?:domains|parsed/(?:.*/)?[^/]*domain)", "mail_client_domain", "tier_3", "email", "mail_client_config", False),
    (r"(?i)^(?:mail_client_config|mail_config)/[^/]+/(?:\[\]/)?(?:emails|parsed/(?:.*/)?[^/]*email)", "mail_client_email", "tier_3", "email", "mail_client_config", False),
    (r"(?i)^(?:mail_client_config|mail_config)/[^/]+/(?:\[\]/)?(?:servers|parsed/(?:.*/)?[^/]*(?:server|host))", "mail_client_server", "tier_3", "email", "mail_client_config", False),
    (r"(?i)^legal_pages/(?:.*/)?[^/]*mail", "contact_email", "tier_3", "legal", "legal_pages.contact", False),
    (r"(?i)^legal_pages/(?:.*/)?[^/]*(?:phone|tel|mobile)", "legal_phone", "tier_3", "legal", "legal_pages.phone", False),
    (r"(?i)^legal_pages/(?:.*/)?[^/]*(?:address|street|city|postal)", "legal_address", "tier_4", "legal", "legal_pages.address", False),
    (r"(?i)^legal_pages/(?:.*/)?[^/]*(?:entity|company|organisation|organization|holder|owner)", "legal_entity", "tier_4", "legal", "legal_pages.entity", False),
    (r"(?i)^legal_pages/(?:.*/)?[^/]*(?:vat|reg|company_number|company-id)", "legal_registration", "tier_3", "legal", "legal_pages.registration", False),
)
#: The same for branches where URLs, or all but URLs, count.
IDENTIFIER_VALUE_PATTERNS = (
    (r"(?i)^page_metadata/meta_tags/(?:.*/)?[^/]*(?:twitter:|og:|social|author)", "social_url", "tier_4", "social", "page_metadata.meta_tags", True),
    (r"(?i)^page_metadata/meta_tags/(?:.*/)?[^/]*(?:twitter:|og:|social|author)", "meta_social_handle", "tier_4", "social", "page_metadata.meta_tags", False),
    (r"^well_known/security_txt(?:/|$)", "policy_url", "tier_4", "policy", "well_known.security_txt", True),
    (r"^(?:mail_client_config|mail_config)/", "mail_client_url", "tier_3", "email", "mail_client_config", True),
    (r"^email_security/tls_rpt(?:/|$)", "tls_rpt", "tier_3", "policy", "email_security.tls_rpt", True),
    (r"^email_security/bimi(?:/|$)", "bimi", "tier_3", "policy", "email_security.bimi", True),
    (r"^email_security/mta_sts(?:/|$)", "mta_sts", "tier_3", "policy", "email_security.mta_sts", True),
)
#: Tokens in TXT records by provider.
TXT_TOKENS = {
    "google_site_verification": r"google-site-verification=([A-Za-z0-9._-]+)", "facebook_domain_verification": r"facebook-domain-verification=([A-Za-z0-9._-]+)", "microsoft": r"\bms=([A-Za-z0-9._-]+)",
    "stripe_verification": r"stripe-verification=([A-Za-z0-9._-]+)", "apple_domain_verification": r"apple-domain-verification=([A-Za-z0-9._-]+)", "zoom_verification": r"zoom-domain-verification=([A-Za-z0-9._-]+)",
    "atlassian_domain_verification": r"atlassian-domain-verification=([A-Za-z0-9._-]+)",
}
#: Paths of certificates; the group is what their identifiers name as source.
CERTIFICATE_PLACES = r"^(tls_certs(?=/probes/\[\]/)|tls_cert(?=/)|non_cf_tls_certs(?=/\[\]/)|(?:crt_sh|cert_transparency)(?=/certs/\[\]/)|origin_candidates/(?:censys|shodan|netlas|scan|provider_scan|country_scan)(?=/hits/\[\]/))/(?:probes/\[\]/|certs/\[\]/|hits/\[\]/|\[\]/)?(?:[^/]+|sans/\[\])$"
