"""A small labelled table of urls, written by hand for training the url filter: 1 unwanted, 0 wanted, then host and path.

Hosts are made up. Unwanted are gambling, pills, loans, adult content, link farms, cracked software, counterfeit goods,
trackers and fake prizes; wanted are what people read. Both labels have short and long hosts, numbers, dates, queries
stripped off, and words of several languages. A fifth of the rows, told by a hash of the host, is held out of training.
"""

from __future__ import annotations

import zlib

import pandas as pd

ROWS = """
1 www.lucky-spins-palace.net /slots/free-spins
1 bet-on-goals.info /odds/football/today
1 royal-roulette.club /play-now
1 m.pokernights.biz /bonus/500
1 online-blackjack-vip.com /register?aff=
1 jackpot-city-games.org /en/slots
1 sportsbetting-tips.win /live/betting
1 mega-lotto-results.top /claim-your-prize
1 scratchcards4u.site /win/cash
1 apuestas-gratis.net /casino/bono
1 gluecksspiel-portal.biz /casino/bonus
1 jeux-casino-gratuits.info /machines-a-sous
1 rx-discount-meds.com /buy-viagra-online
1 canadian-pharmacy-direct.net /cialis/cheap
1 no-prescription-pills.biz /order/tramadol
1 slimfast-miracle.shop /diet-pills/buy
1 keto-burn-gummies.store /order-now
1 testosterone-booster.top /free-trial
1 herbal-enlargement.info /pills/order
1 cbd-cure-all.site /buy/oil
1 farmacia-barata.biz /comprar/pastillas
1 medikamente-ohne-rezept.net /kaufen
1 fast-payday-cash.com /apply/bad-credit
1 instant-loans-4-you.net /loan/approve
1 debt-erase-today.biz /credit-repair
1 forex-millionaire.club /signup/bonus
1 bitcoin-doubler.top /invest/now
1 crypto-profit-robot.site /join
1 binary-options-rich.info /trade/free-money
1 work-from-home-cash.biz /earn/5000-weekly
1 kredit-sofort.top /ohne-schufa
1 hot-singles-tonight.com /chat/sexy
1 xxx-video-tube.net /porn/free
1 adult-webcams.biz /live/girls
1 milf-dates.info /hookup/near-you
1 escort-city.club /girls/independent
1 nude-pics-daily.site /gallery/sex
1 sexshop-discreet.store /adult/toys
1 porno-gratis.top /videos/xxx
1 cam4free-girls.com /sexcam
1 cheap-seo-backlinks.com /buy-links/1000
1 guestbook-link-farm.net /add-url
1 web-directory-submit.biz /links/page9
1 article-spinner-pro.info /spam/keywords
1 traffic-exchange-bot.top /autosurf
1 instagram-followers-buy.site /cheap/followers
1 expired-domain-traffic.biz /redirect/offers
1 cheap-replica-watches.com /rolex/replica
1 designer-handbags-outlet.shop /cheap/fake
1 discount-sneakers-sale.store /outlet/90-off
1 sunglasses-outlet.top /cheap/replica
1 warez-downloads.net /cracked/keygen
1 serial-keys-free.info /crack/full-version
1 torrent-movies-hd.site /download/free-full
1 free-mp3-ripper.biz /download/setup.exe
1 crack4pc.top /activator/patch
1 game-hacks-cheats.club /generator/free-coins
1 driver-update-scan.com /download/fix-now
1 pc-cleaner-alert.site /virus/warning
1 you-won-prize.top /claim/iphone
1 free-giftcards-now.info /survey/win
1 congratulations-winner.site /reward/claim
1 survey-rewards-club.com /prize/cash
1 account-verify-secure.top /login/confirm
1 bank-update-alert.info /verify/password
1 adserver-popunder.net /banner/click
1 trk-clicks.biz /pixel/aff_c
1 popads-delivery.top /serve/ad
1 affiliate-offers-track.com /click/offer
1 push-notify-ads.site /subscribe/push
1 miracle-weight-loss.org /order/pills
1 winning-lottery-numbers.biz /jackpot/tonight
1 cheap-cigarettes-online.net /buy/carton
1 fake-diploma-buy.com /order/degree
1 essay-writers-cheap.biz /buy/essay
1 hidden-spycam.club /adult/video
1 grand-casino-online.net /games/roulette
1 casino-bonus-hunter.com /free/bonus
1 crazybets.win /live
1 topcasinolist.info /reviews/best-bonus
1 freebets-daily.site /football/bets
1 pokerstakes.club /freeroll
1 slotmachine-fun.top /spin
1 win-money-quiz.biz /prize/draw
1 pillstore24.net /men/viagra
1 cheapmeds-online.com /pills/order-now
1 pharmacy-express.top /buy/pills
1 weightloss-pills.site /cheap
1 quickloans-online.com /loan/payday
1 easy-loan-approval.info /apply
1 payday-advance.top /cash/loan
1 casinobonus-ohne-einzahlung.net /freispiele
1 xxx-adult-dating.com /free/chat
1 sexy-girls-live.net /cams
1 pornhdclips.top /xxx/video
1 adult-toplist.biz /sex/links
1 replica-bags-cheap.net /buy/replica
1 fakewatches.store /replica/cheap
1 outlet-brands-discount.biz /90-off
1 keygen-crack.net /download/serial
1 crackedapps.club /free/download
1 freetorrents.top /movies/full
1 download-cracked-games.biz /torrent
1 clickads-network.com /banner/serve
1 ad-tracker-pixel.net /click/redirect
1 popup-ads.biz /serve/banner
1 spam-comments-tool.com /buy/links
1 backlinks-cheap.net /seo/spam
1 claim-reward-now.club /winner/gift
1 iphone-winner.top /claim
1 secure-login-confirm.biz /account/verify
1 doubler-crypto.club /free/bitcoin
0 www.harbour-gazette.com /2021/03/14/council-votes-on-bridge
0 riverside-museum.org /exhibitions/glass
0 openmaps-wiki.net /page/Projection
0 garden-notes.info /roses/pruning
0 kitchen-diary.com /recipes/lentil-soup
0 mountain-rescue.org /reports/2019
0 citylibrary.net /catalogue/new-books
0 astro-club.info /planets/saturn
0 dailyobserver.com /world/europe/article-48213
0 school-of-music.org /courses/violin
0 birdwatchers.net /species/robin
0 localweather.info /forecast/week
0 chess-academy.org /openings/sicilian
0 codeforge.net /docs/install
0 learn-statistics.com /chapter/3/regression
0 railwayhistory.org /lines/branch
0 health-advice.info /guide/sleep
0 parents-forum.net /thread/20418
0 cyclists-union.org /routes/coast
0 bakery-on-main.com /bread/rye
0 history-today-podcast.net /episode/112
0 uni-physics.org /lectures/optics
0 villagehall.info /events/june
0 oldbooks.shop /poetry/first-editions
0 film-review.net /2018/drama
0 marine-biology.org /research/corals
0 woodworking-bench.com /joints/dovetail
0 languagelab.net /spanish/verbs
0 theatre-royal.info /tickets/macbeth
0 greenenergy-news.com /wind/offshore
0 jazz-archive.org /artists/saxophone
0 travel-slowly.net /portugal/porto
0 bicycle-repair.info /brakes/adjust
0 childrens-hospital.org /departments/heart
0 legal-handbook.com /contracts/terms
0 openscience.net /papers/2207
0 stadtmuseum.org /ausstellung/moderne
0 zeitung-am-sonntag.com /politik/wahlen
0 rezepte-kueche.net /kuchen/apfel
0 wanderwege.info /alpen/huetten
0 bibliotheque-ville.org /romans/nouveautes
0 journal-du-soir.com /culture/cinema
0 cuisine-simple.net /recettes/soupe
0 histoire-locale.info /moyen-age/chateaux
0 periodico-local.com /noticias/deportes
0 recetas-caseras.net /postres/flan
0 museo-nacional.org /coleccion/pintura
0 biblioteca-publica.info /libros/infantil
0 photo-club.net /landscape/autumn
0 gardencentre.com /plants/shrubs
0 knitting-circle.info /patterns/scarf
0 football-league.org /results/saturday
0 running-club.net /marathon/training
0 startup-journal.com /interviews/founders
0 physics-forum.net /question/7731
0 opencourse.org /biology/cells
0 townarchive.info /maps/1880
0 coffee-roasters.com /beans/ethiopia
0 familydoctor.net /symptoms/cough
0 vegetable-plots.org /compost/beginners
0 data-journal.com /charts/inflation
0 railtimetable.net /stations/north
0 poetry-review.org /issues/spring
0 architecture-week.info /houses/timber
0 software-notes.com /blog/2020/testing
0 veterinary-care.net /dogs/vaccines
0 art-history.org /renaissance/florence
0 farmers-market.info /stalls/cheese
0 election-watch.com /polls/region
0 mathsolver.net /algebra/quadratic
0 sailing-school.org /courses/dinghy
0 m.evening-post.com /local/traffic
0 blog.quietwoods.net /walks/beech
0 news.lakeside.info /schools/opening
0 docs.querylib.org /reference/window
0 wiki.stonebuilders.net /index/arches
0 forum.potters.info /glaze/recipes
0 shop.paperandink.com /notebooks/a5
0 en.worldgeography.org /rivers/danube
0 de.naturfreunde.net /voegel/meise
0 www.orchard-society.org /apples/varieties
0 tidewater-times.com /weather/storm-warning
0 community-college.net /admissions/spring
0 hillside-observatory.org /events/eclipse
0 metro-transit.info /lines/blue/stops
0 springfield-bridge.com /history
0 quiet-reader.com /essays/on-walking
0 ceramics-today.net /kilns/wood-firing
0 open-seeds.org /beans/heirloom
0 winter-sports.info /skating/results
0 winery-tours.net /valley/tastings
0 better-sleep.org /guide/children
0 bettina-photography.net /portraits
0 loanwords-dictionary.org /english/french
0 essex-county.info /parks/trails
0 adjectives-grammar.com /lessons/adverbs
0 spinning-and-weaving.org /wool/wheels
0 credit-union-members.org /about/board
0 pharmacology-notes.net /receptors
0 downloadable-maps.org /topographic/sheets
0 www.carpentry-guild.net /apprentices
0 literary-prize.org /shortlist/2020
0 freewheel-cycling.com /tours/summer
0 lottie-bakes.com /scones
"""


def held_out(host: str) -> bool:
    """Whether a host is left out of training."""
    return zlib.crc32(host.encode()) % 5 == 0


def labelled_urls() -> pd.DataFrame:
    """host, path, label (1: unwanted) and held_out of every row."""
    rows = [line.split() for line in ROWS.strip().splitlines()]
    return pd.DataFrame([(host, path, int(label), held_out(host)) for label, host, path in rows], columns=["host", "path", "label", "held_out"])
