"""What is known of technologies: signs by which a site shows them, and what they imply.

Fixed values: public marks that products leave in headers, cookies, file names, hosts and markup. A group in a pattern is the version.
"""

from __future__ import annotations

#: (name, category, kind of signal, pattern)
RULES: list[tuple[str, str, str, str]] = [
    ("WordPress", "cms", "generator", r"^wordpress\s*([\d.]*)"), ("WordPress", "cms", "style", r"/wp-(?:content|includes)/(?:css/dist/[^?]*\?ver=([\d.]+))?"), ("WordPress", "cms", "script", r"/wp-(?:content|includes)/"),
    ("WooCommerce", "cms", "style", r"/plugins/woocommerce/[^?]*\?ver=([\d.]+)"), ("WooCommerce", "cms", "html", r"\bwoocommerce_params\b"),
    ("Drupal", "cms", "generator", r"^drupal\s*([\d.]*)"), ("Drupal", "cms", "header", r"^x-drupal-cache:"), ("Joomla", "cms", "generator", r"^joomla"), ("Ghost", "cms", "generator", r"^ghost\s*([\d.]*)"),
    ("Hugo", "cms", "generator", r"^hugo\s*([\d.]*)"), ("Jekyll", "cms", "generator", r"^jekyll\s*v?([\d.]*)"), ("Webflow", "cms", "generator", r"^webflow"), ("Webflow", "cms", "html", r"\bdata-wf-site="),
    ("Wix", "cms", "generator", r"^wix\.com"), ("Squarespace", "cms", "host", "squarespace.com"), ("Shopify", "cms", "host", "myshopify.com"), ("Shopify", "cms", "host", "shopify.com"), ("Shopify", "cms", "header", r"^x-shopid:"),
    ("Next.js", "framework", "script", r"/_next/static/"), ("Next.js", "framework", "header", r"^x-powered-by:\s*next\.js\s*([\d.]*)"), ("Next.js", "framework", "html", r"\bid=.__NEXT_DATA__"),
    ("Nuxt", "framework", "script", r"/_nuxt/"), ("Nuxt", "framework", "html", r"\bwindow\.__NUXT__"), ("Gatsby", "framework", "generator", r"^gatsby\s*([\d.]*)"), ("Astro", "framework", "generator", r"^astro\s*v?([\d.]*)"),
    ("React", "framework", "js", r"version:.([\d.]+).,rendererPackageName:.react-dom"), ("React", "framework", "html", r"\bdata-reactroot\b"), ("Vue", "framework", "script", r"/vue(?:@|[.\-/])v?([\d.]*\d)"), ("Angular", "framework", "html", r"\bng-version=.([\d.]+)"),
    ("Svelte", "framework", "html", r"\bclass=.[^\"']*\bsvelte-\w+"), ("jQuery", "ui", "script", r"/jquery(?:[.\-@/]v?([\d.]*\d))?[\w.\-/]*\.js"), ("Bootstrap", "ui", "style", r"/bootstrap(?:@|[.\-/])?([\d.]*\d)?[^/]*\.css"), ("GSAP", "ui", "script", r"/gsap@([\d.]*\d)/"),
    ("Nginx", "server", "header", r"^server:\s*nginx(?:/([\d.]+))?"), ("Apache", "server", "header", r"^server:\s*apache(?:/([\d.]+))?"), ("IIS", "server", "header", r"^server:\s*microsoft-iis(?:/([\d.]+))?"), ("Caddy", "server", "header", r"^server:\s*caddy"),
    ("LiteSpeed", "server", "header", r"^server:\s*litespeed"), ("PHP", "language", "header", r"^x-powered-by:\s*php(?:/([\d.]+))?"), ("PHP", "language", "cookie", r"^phpsessid$"), ("ASP.NET", "language", "header", r"^x-aspnet-version:\s*([\d.]+)"),
    ("Express", "framework", "header", r"^x-powered-by:\s*express"), ("Laravel", "framework", "cookie", r"^laravel_session$"), ("Django", "framework", "cookie", r"^csrftoken$"), ("Ruby on Rails", "framework", "header", r"^x-runtime:"), ("Java", "language", "cookie", r"^jsessionid$"),
    ("Vercel", "hosting", "header", r"^x-vercel-id:"), ("Netlify", "hosting", "header", r"^x-nf-request-id:"), ("GitHub Pages", "hosting", "header", r"^server:\s*github\.com"), ("Heroku", "hosting", "header", r"^via:.*\bvegur\b"), ("Fly.io", "hosting", "header", r"^fly-request-id:"),
    ("Cloudflare", "cdn", "header", r"^(?:server:\s*cloudflare|cf-ray:)"), ("Fastly", "cdn", "header", r"^x-served-by:\s*cache-"), ("CloudFront", "cdn", "header", r"^x-amz-cf-id:"), ("Akamai", "cdn", "header", r"^x-akamai-"), ("jsDelivr", "cdn", "host", "cdn.jsdelivr.net"), ("unpkg", "cdn", "host", "unpkg.com"), ("cdnjs", "cdn", "host", "cdnjs.cloudflare.com"),
    ("Google Fonts", "fonts", "host", "fonts.googleapis.com"), ("Google Fonts", "fonts", "host", "fonts.gstatic.com"), ("Adobe Fonts", "fonts", "host", "use.typekit.net"), ("Font Awesome", "fonts", "script", r"kit\.fontawesome\.com"),
    ("Google Analytics", "analytics", "cookie", r"^_ga(?:_|$)"), ("Google Analytics", "analytics", "host", "google-analytics.com"), ("Google Tag Manager", "analytics", "host", "www.googletagmanager.com"), ("Plausible", "analytics", "host", "plausible.io"), ("Matomo", "analytics", "script", r"/(?:matomo|piwik)\.js"), ("Hotjar", "analytics", "host", "hotjar.com"), ("Segment", "analytics", "host", "cdn.segment.com"), ("PostHog", "analytics", "js", r"\bposthog\.init\("),
    ("Sentry", "monitoring", "js", r"\b__SENTRY__\b"), ("Sentry", "monitoring", "host", "sentry.io"), ("Datadog", "monitoring", "host", "browser-intake-datadoghq.com"), ("Stripe", "payments", "host", "js.stripe.com"), ("PayPal", "payments", "host", "www.paypalobjects.com"), ("reCAPTCHA", "security", "script", r"/recaptcha/(?:api|enterprise)\.js"), ("hCaptcha", "security", "host", "hcaptcha.com"), ("Turnstile", "security", "host", "challenges.cloudflare.com"),
    ("Intercom", "support", "host", "intercom.io"), ("Zendesk", "support", "host", "zdassets.com"), ("Crisp", "support", "host", "client.crisp.chat"), ("webpack", "build", "js", r"\bwebpackChunk\w*"), ("Vite", "build", "script", r"/@vite/client"), ("Alpine.js", "framework", "html", r"\bx-data="), ("htmx", "framework", "html", r"\bhx-(?:get|post)="), ("Tailwind CSS", "ui", "html", r"--tw-[a-z]"),
    ("GSAP", "ui", "js", r"\bGSAP (\d[\d.]*\d)"), ("Svelte", "framework", "js", r"\bsvelte-[a-z0-9]{6,}\b"), ("Stripe", "payments", "link", r"^(?:buy|checkout)\.stripe\.com$"), ("Vercel", "hosting", "site", r"\.vercel\.app$"), ("Netlify", "hosting", "site", r"\.netlify\.app$"), ("GitHub Pages", "hosting", "site", r"\.github\.io$"),
]

#: The hosts that vendors serve from, by category; a host below one counts as well.
VENDOR_HOSTS: dict[str, dict[str, str]] = {
    "analytics": {"Mixpanel": "cdn.mxpnl.com", "Amplitude": "cdn.amplitude.com", "Heap": "cdn.heapanalytics.com", "FullStory": "edge.fullstory.com", "Clarity": "clarity.ms", "Fathom": "cdn.usefathom.com", "Simple Analytics": "scripts.simpleanalyticscdn.com", "Umami": "analytics.umami.is", "Mouseflow": "cdn.mouseflow.com", "Crazy Egg": "script.crazyegg.com", "Yandex Metrica": "mc.yandex.ru", "Quantcast": "quantserve.com"},
    "ads": {"Google Ads": "googleadservices.com", "DoubleClick": "doubleclick.net", "Meta Pixel": "connect.facebook.net", "Criteo": "static.criteo.net", "LinkedIn Insight": "snap.licdn.com", "Taboola": "cdn.taboola.com", "Outbrain": "widgets.outbrain.com"},
    "support": {"Drift": "js.driftt.com", "Tawk.to": "embed.tawk.to", "LiveChat": "cdn.livechatinc.com", "HubSpot": "js.hs-scripts.com", "Freshchat": "wchat.freshchat.com", "Olark": "static.olark.com"},
    "monitoring": {"New Relic": "js-agent.newrelic.com", "LogRocket": "cdn.lr-ingest.io", "Bugsnag": "d2wy8f7a9ursnm.cloudfront.net", "Rollbar": "cdn.rollbar.com"},
    "media": {"YouTube": "youtube.com", "Vimeo": "player.vimeo.com", "Wistia": "fast.wistia.com", "Mux": "stream.mux.com", "Cloudinary": "res.cloudinary.com", "imgix": "imgix.net"},
    "cms": {"Contentful": "images.ctfassets.net", "Sanity": "cdn.sanity.io", "Prismic": "cdn.prismic.io", "Storyblok": "a.storyblok.com", "DatoCMS": "datocms-assets.com"},
    "auth": {"Auth0": "cdn.auth0.com", "Okta": "oktacdn.com", "Clerk": "clerk.accounts.dev"},
    "payments": {"Braintree": "js.braintreegateway.com", "Square": "web.squarecdn.com", "Klarna": "js.klarna.com", "Paddle": "cdn.paddle.com"},
    "consent": {"OneTrust": "cdn.cookielaw.org", "Cookiebot": "consent.cookiebot.com", "Didomi": "sdk.privacy-center.org"},
    "testing": {"Optimizely": "cdn.optimizely.com", "VWO": "dev.visualwebsiteoptimizer.com", "LaunchDarkly": "app.launchdarkly.com"},
}
RULES += [(name, category, "host", domain) for category, own in VENDOR_HOSTS.items() for name, domain in own.items()]

#: Weak signs: names that other projects use as well, of which several have to stand in one value.
WEAK_RULES: list[tuple] = [
    ("Tailwind CSS", "ui", "html", ("items-center", "justify-between", "mx-auto", "max-w-", "rounded-lg", "text-sm", "font-semibold", "flex-col"), 4),
    ("Bootstrap", "ui", "html", ("col-md-", "navbar-toggler", "btn-primary", "data-bs-", "container-fluid"), 3),
    ("Solana wallet", "web3", "js", ("PhantomWalletAdapter", "SolflareWalletAdapter", "walletStandard", "useWallet"), 2),
]

#: (name, what it implies)
IMPLIES: list[tuple[str, str]] = [
    ("Next.js", "React"), ("Gatsby", "React"), ("Nuxt", "Vue"), ("WordPress", "PHP"), ("WooCommerce", "WordPress"), ("Drupal", "PHP"), ("Joomla", "PHP"), ("Laravel", "PHP"), ("Express", "Node.js"), ("Next.js", "Node.js"), ("Nuxt", "Node.js"), ("Ghost", "Node.js"), ("Turnstile", "Cloudflare"),
]
